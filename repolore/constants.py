"""Fixed values. They must equal the original rules for the results to be right."""

# --- corpus: extensions, excluded names -------------------------------------------------------
CODE_EXTENSIONS = [
    "py", "js", "ts", "java", "cpp", "c", "h", "hpp", "go", "rs", "jsx", "tsx", "html", "css", "php", "swift", "cs",
]
DOC_EXTENSIONS = ["md", "txt", "rst", "json", "yaml", "yml"]

EXCLUDED_DIRS = [
    "./.venv/", "./venv/", "./env/", "./virtualenv/", "./node_modules/", "./bower_components/", "./jspm_packages/",
    "./.git/", "./.svn/", "./.hg/", "./.bzr/",
    "./__pycache__/", "./.pytest_cache/", "./.mypy_cache/", "./.ruff_cache/", "./.coverage/",
    "./dist/", "./build/", "./out/", "./target/", "./bin/", "./obj/",
    "./docs/", "./_docs/", "./site-docs/", "./_site/",
    "./.idea/", "./.vscode/", "./.vs/", "./.eclipse/", "./.settings/",
    "./logs/", "./log/", "./tmp/", "./temp/",
]
EXCLUDED_FILES = [
    "yarn.lock", "pnpm-lock.yaml", "npm-shrinkwrap.json", "poetry.lock", "Pipfile.lock", "requirements.txt.lock",
    "Cargo.lock", "composer.lock", ".lock", ".DS_Store", "Thumbs.db", "desktop.ini", "*.lnk", ".env", ".env.*",
    "*.env", "*.cfg", "*.ini", ".flaskenv", ".gitignore", ".gitattributes", ".gitmodules", ".github",
    ".gitlab-ci.yml", ".prettierrc", ".eslintrc", ".eslintignore", ".stylelintrc", ".editorconfig", ".jshintrc",
    ".pylintrc", ".flake8", "mypy.ini", "pyproject.toml", "tsconfig.json", "webpack.config.js", "babel.config.js",
    "rollup.config.js", "jest.config.js", "karma.conf.js", "vite.config.js", "next.config.js", "*.min.js",
    "*.min.css", "*.bundle.js", "*.bundle.css", "*.map", "*.gz", "*.zip", "*.tar", "*.tgz", "*.rar", "*.7z",
    "*.iso", "*.dmg", "*.img", "*.msix", "*.appx", "*.appxbundle", "*.xap", "*.ipa", "*.deb", "*.rpm", "*.msi",
    "*.exe", "*.dll", "*.so", "*.dylib", "*.o", "*.obj", "*.jar", "*.war", "*.ear", "*.jsm", "*.class", "*.pyc",
    "*.pyd", "*.pyo", "__pycache__", "*.a", "*.lib", "*.lo", "*.la", "*.slo", "*.dSYM", "*.egg", "*.egg-info",
    "*.dist-info", "*.eggs", "node_modules", "bower_components", "jspm_packages", "lib-cov", "coverage", "htmlcov",
    ".nyc_output", ".tox", "dist", "build", "bld", "out", "bin", "target", "packages/*/dist", "packages/*/build",
    ".output",
]
LISTING_PRUNED_DIRS = ["__pycache__", "node_modules", ".venv"]
LISTING_SKIPPED_FILES = ["__init__.py", ".DS_Store"]

# --- limits -------------------------------------------------------------------------------------
EMBED_TOKEN_LIMIT = 8192
CODE_TOKEN_FACTOR = 10
CHUNK_WORDS = 350
CHUNK_OVERLAP = 100
TOP_K = 20
REQUEST_TOKEN_LIMIT = 8000
PACK_BUDGET = 30000
MAX_RESEARCH_ITERATIONS = 5
EMBED_BATCH = 500

# --- identity -----------------------------------------------------------------------------------
HOSTED_TYPES = ["github", "gitlab", "bitbucket"]
WINDOWS_PATH = r'^[a-zA-Z]:\\(?:[^\\/:*?"<>|\r\n]+\\)*[^\\/:*?"<>|\r\n]*$'
REPO_URL = r"^(?:https?:\/\/)?([^\/]+)\/(.+?)\/([^\/]+)(?:\.git)?\/?$"
LANGUAGES = {
    "en": "English",
    "ja": "Japanese (日本語)",
    "zh": "Mandarin Chinese (中文)",
    "zh-tw": "Traditional Chinese (繁體中文)",
    "es": "Spanish (Español)",
    "kr": "Korean (한국어)",
    "vi": "Vietnamese (Tiếng Việt)",
    "pt-br": "Brazilian Portuguese (Português Brasileiro)",
    "fr": "Français (French)",
    "ru": "Русский (Russian)",
}
DEFAULT_LANGUAGE = "en"
CACHE_PREFIX = "wiki_cache_"

# --- conversation ---------------------------------------------------------------------------------
RESEARCH_TAG = "[DEEP RESEARCH]"
CONTINUE_MESSAGE = "[DEEP RESEARCH] Continue the research"
TOKEN_LIMIT_ERRORS = ["maximum context length", "token limit", "too many tokens"]
NO_CONTEXT_NOTE = "<note>Answering without retrieval augmentation.</note>"
SIMPLIFIED_NOTE = "<note>Answering without retrieval augmentation due to input size constraints.</note>"

# --- model calls: request bodies per vendor -----------------------------------------------------------
ANTHROPIC_VERSION = "bedrock-2023-05-31"
MAX_ANSWER_TOKENS = 4096
TEMPERATURE = 0.7
TOP_P = 0.8

# --- wiki -----------------------------------------------------------------------------------------
CATEGORIES = [
    ("overview", "Overview", ["overview", "introduction", "about"]),
    ("architecture", "Architecture", ["architecture", "structure", "design", "system"]),
    ("features", "Core Features", ["feature", "functionality", "core"]),
    ("components", "Components", ["component", "module", "widget"]),
    ("api", "API", ["api", "endpoint", "service", "server"]),
    ("data", "Data Flow", ["data", "flow", "pipeline", "storage"]),
    ("models", "Models", ["model", "ai", "ml", "integration"]),
    ("ui", "User Interface", ["ui", "interface", "frontend", "page"]),
    ("setup", "Setup & Configuration", ["setup", "config", "installation", "deploy"]),
]
OTHER_CATEGORY = ("other", "Other")
IMPORTANCE_SECTIONS = [
    ("high", "section-high", "Core Components"),
    ("medium", "section-medium", "Key Features"),
    ("low", "section-low", "Additional Information"),
]
MISSING_CONTENT = "Content not generated"
LOADING_CONTENT = "Loading..."

# --- derived documents ------------------------------------------------------------------------------
NO_SUMMARY = "No summary available"
SLIDE_DOTTED = r"[0-9]+\.[{s}]+(.*?)(?=\n[0-9]+\.|\n*\z)"
SLIDE_BRACKETED = r"[0-9]+\)[{s}]+(.*?)(?=\n[0-9]+\)|\n*\z)"
SLIDE_NAMED = r"(?i)Slide[{s}]+[0-9]+[{s}]*:?[{s}]*(.*?)(?=\nSlide|\n*\z)"
SLIDE_TITLED = r"(?m)^([^:\n]+)(?::[{s}]*(.*?))?$"
SLIDE_TITLE_BLOCKERS = ["please", "here"]
DEFAULT_SLIDES = [
    "Title Slide: Introduction to {repo}",
    "Overview: Key features and purpose of {repo}",
    "Architecture: System components and structure",
    "Features: Main capabilities and functionalities",
    "Implementation: How it works and technical details",
    "Use Cases: How to use {repo} effectively",
    "Conclusion: Summary and next steps",
]
FORCED_CONCLUSION = (
    "\n\n## Final Conclusion\nAfter multiple iterations of deep research, we've gathered significant insights about "
    "this topic. This concludes our investigation process, having reached the maximum number of research iterations. "
    "The findings presented across all iterations collectively form our comprehensive answer to the original question."
)
CONCLUSION_BLOCKERS = ["I will now proceed to", "Next Steps", "next iteration"]
CONCLUDING_PHRASES = [
    "This concludes our research",
    "This completes our investigation",
    "This concludes the deep research process",
    "Key Findings and Implementation Details",
    "In conclusion,",
]
EXERCISE_NOTE = (
    '<div style="text-align: right; font-size: 0.85em; color: #666;">\n'
    "Exercise {i} of {n} | Estimated time: {minutes} minutes\n</div>\n\n"
)
FINAL_PROJECT_NOTE = (
    '<div style="text-align: right; font-size: 0.85em; color: #666;">\n'
    "Estimated time: 20-30 minutes | Combines concepts from all exercises\n</div>\n\n"
)
