"""Benchmark decontamination by template canonicalisation.

Words become canonical tokens: numbers, names (capitalised inside a sentence) and units (after a number) turn into typed
placeholders; other words are lower-cased without punctuation around them. An item shorter than a window of ``width`` tokens is one
window. A window that holds fewer than ``plain`` ordinary words (or not only such, if shorter) is compared by its plain text.

1. *Items.* Spark cuts the benchmark into windows. Items with equal windows whose placeholders repeat alike are one *template*; the least
   item stands for it and its row says how many items it has.
2. *Hits.* Documents are read once. A task sends the windows whose bit is set in a bitmap of the benchmark's windows, of
   fixed size, with the words behind them; windows that share a bit by chance find no partner later.
3. *Matches.* Hits are hash-joined with the templates' windows. A window that more than ``shared`` templates hold starts no match by itself, unless
   it is the rarest of its template: an opening that many questions have in common is no leak of them. It counts where
   another window has matched the template at the same place. With ``shared`` None every window counts wherever it stands, however many
   templates hold it: the windows that may start a match are then the rarest ones without which the rest covers less than ``share`` of
   the item, so no leak lacks them. What a window's first token is depends on the word
   before it, so it agrees if it is the same token or the same word.
4. *Slots.* The values behind placeholders must map one to one: equal values in the item stand for equal values in the
   document, and the reverse. Where they conflict, a pair holds if it has more than half the places of both its values, and windows
   with another pair are dropped; a window that agrees word for word always counts. Windows left that cover at least ``share`` of an
   item make a leak, so re-parameterised questions count too.

Null and empty texts hold nothing, items without an id are left out, an empty table on either side gives no leaks. Rows that repeat give their
document's leaks once. Texts are read whole. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repolore.llm import arrays as A
from repolore.llm.bpe import Kept
from repolore.session import cut_lineage

#: Words that name a unit when a number stands before them.
UNITS = frozenset("% g kg mg lb lbs oz t m km cm mm mi ft in yd l ml s ms min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years eur usd gbp dollar dollars euro euros cent cents meter meters metre metres mile miles liter liters litre litres gram grams kilogram kilograms percent degrees °c °f".split())
PUNCTUATION = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])) + "“”‘’«»…–—¿¡"
PLAIN, NUMBER, NAME, UNIT = range(4)
_ENDS = 8  # flag: the word ends a sentence; line ends are not looked at, so wrapped text stays alike
_TYPES = np.array([0, 0x6E756D, 0x6E616D65, 0x756E6974], np.uint64)
_WINDOW = pa.schema([*((c, pa.int64()) for c in ("template", "item_id", "text_key", "n", "size", "q", "hash", "first")), ("kinds", pa.binary()), ("item_values", pa.binary())])
_WINDOW_DDL = "template long, item_id long, text_key long, n long, size long, q long, hash long, first long, kinds binary, item_values binary"
_HIT = pa.schema([*((c, pa.int64()) for c in ("row", "doc_id", "hash", "p", "doc_first")), ("doc_values", pa.binary())])
_HIT_DDL = "row long, doc_id long, hash long, p long, doc_first long, doc_values binary"
_LEAK = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "n_matched", "n_item", "first_word", "n_items")])
_LEAK_DDL = "doc_id long, item_id long, n_matched long, n_item long, first_word long, n_items long"


def _word(raw: bytes) -> int:
    """Hash of one word without case and punctuation, with its kind and flag in the low four bits."""
    w = raw.decode("utf-8", "surrogatepass")
    core = w.strip(PUNCTUATION)
    ends = _ENDS if w.rstrip("\"')]}”’»")[-1:] in (".", "!", "?", ":", "…") else 0
    low = core.lower()
    if core and core[0].isdigit() and all(c.isdigit() or c in ".,:/-+" for c in core):
        kind = NUMBER
    elif low in UNITS or w == "%":
        kind = UNIT
    elif len(core) > 1 and core[0].isupper() and core[1:].islower():
        kind = NAME
    else:
        kind = PLAIN
    return xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass") or raw) & ~15 | kind | ends


_CODES = Kept(_word, 600_000)


def tokens(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, kinds, values) of a text's words; a placeholder's token hash is its kind's."""
    w = A.words(text)
    code = np.fromiter(map(_CODES.__getitem__, w), np.uint64, len(w))
    flags = (code & np.uint64(15)).astype(np.uint8)
    kind = flags & 3
    if len(w):
        kind[(kind == NAME) & np.r_[True, (flags[:-1] & _ENDS) > 0]] = PLAIN
        kind[(kind == UNIT) & np.r_[True, kind[:-1] != NUMBER]] = PLAIN
    value = code >> np.uint64(4)
    return np.where(kind == PLAIN, A.mix(value), _TYPES[kind]), kind, value


def _tails(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive tokens but the first of them."""
    return A.window_hashes(h, size - 1)[1:]


def _cut(text: str | None, width: int, plain: int):
    """(tokens, kinds, values, windows) of an item; windows are (size, place, hash), the size below 0 for plain text."""
    h, kind, value = tokens(text)
    n = len(h)
    if not n:
        return None
    size = min(width, n)
    held = np.r_[0, np.cumsum(kind == PLAIN)]
    ok = (held[size:] - held[:-size]) >= min(plain, size)
    if size == 1:  # no tail
        ok[:] = False
    return h, kind, value, np.where(ok, size, -size), np.where(ok, _hashes(h, value, size), _hashes(h, value, -size))


def _hashes(h: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of a text; of its plain words if ``size`` is below 0."""
    own = A.window_hashes(A.mix(value), -size) if size < 0 else _tails(h, size) if size > 1 else h
    return A.mix(own + np.uint64(size & 0xFFFF))


def _items(width: int, plain: int):
    def run(batches):
        for batch in batches:
            cols = [[] for _ in _WINDOW.names]
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if (cut := _cut(text, width, plain)) is None:
                    continue
                h, kind, value, sizes, hashes = cut
                slots = np.flatnonzero(kind != PLAIN)
                _, first = np.unique(value[slots], return_inverse=True)
                order = {v: i for i, v in reversed(list(enumerate(first.tolist())))}  # first place of each value
                pattern = np.array([order[v] for v in first.tolist()], np.int64)
                template = xxhash.xxh3_64_intdigest(b"".join((hashes.tobytes(), kind.tobytes(), pattern.tobytes()))) >> 1
                text_key = xxhash.xxh3_64_intdigest(value.tobytes()) >> 1
                for q, (size, key) in enumerate(zip(sizes.tolist(), A.signed(hashes).tolist(), strict=True)):
                    part = slice(q, q + abs(size))
                    for c, x in zip(cols, (template, item, text_key, len(h), size, q, key, int(h[q].view(np.int64)), kind[part].tobytes(), value[part].tobytes()), strict=True):
                        c.append(x)
                if len(cols[0]) > 20_000:
                    yield A.rows(_WINDOW, dict(zip(_WINDOW.names, cols, strict=True)))
                    cols = [[] for _ in _WINDOW.names]
            yield A.rows(_WINDOW, dict(zip(_WINDOW.names, cols, strict=True)))

    return run


def _hits(sizes: list[int], bitmap):
    def run(batches):
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            cols = [[] for _ in _HIT.names]
            for row, doc, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                h, _, value = tokens(text)
                for size in sizes:
                    if len(h) < abs(size):
                        continue
                    own = _hashes(h, value, size)
                    for p in np.flatnonzero(A.in_bitmap(bits, own)).tolist():
                        for c, x in zip(cols, (row, doc, int(own[p].view(np.int64)), p, int(h[p].view(np.int64)), value[p : p + abs(size)].tobytes()), strict=True):
                            c.append(x)
                if len(cols[0]) > 20_000:
                    yield A.rows(_HIT, dict(zip(_HIT.names, cols, strict=True)))
                    cols = [[] for _ in _HIT.names]
            yield A.rows(_HIT, dict(zip(_HIT.names, cols, strict=True)))

    return run


def _agreeing(windows: list[tuple[int, bytes, bytes, bytes]]) -> set[int]:
    """The tokens of the windows (place, kinds, item's values, document's values) whose slots map one to one, or that agree word for word."""
    slot: dict = {}  # of each placeholder: the item's and the document's value
    for q, kinds, item, doc in windows:
        mine, other = np.frombuffer(item, np.uint64).tolist(), np.frombuffer(doc, np.uint64).tolist()
        for i, k in enumerate(kinds):
            if k != PLAIN:
                slot[q + i] = (k, mine[i]), (k, other[i])
    places: dict = defaultdict(int)
    for a, b in slot.values():
        for key in ((a, b), (a, None), (None, b)):
            places[key] += 1
    ok = {q: 2 * places[a, b] > max(places[a, None], places[None, b]) for q, (a, b) in slot.items()}
    out: set[int] = set()
    for q, kinds, item, doc in windows:
        at = range(q, q + len(kinds))
        if item == doc or all(ok.get(i, True) for i in at):
            out.update(at)
    return out


def _judge(share: float):
    """Leaks among rows that are sorted by document row, template and shift; a template's windows at one shift are held at once."""

    def run(batches):
        out = [[] for _ in _LEAK.names]
        now, shift, windows, held, first = None, None, [], set(), None

        def settle():
            nonlocal windows, held, first
            if windows and (found := _agreeing(windows)):
                held = held | found
                first = min(x for x in (first, shift + min(found)) if x is not None)
            windows = []

        def close():
            nonlocal held, first
            if now and held and len(held) >= share * now[4]:
                for c, x in zip(out, (now[2], now[3], len(held), now[4], first, now[5]), strict=True):
                    c.append(x)
            held, first = set(), None

        for batch in batches:
            for r in batch.to_pylist():
                key = (r["row"], r["template"], r["doc_id"], r["item_id"], r["n"], r["n_items"])
                if key != now or r["shift"] != shift:
                    settle()
                    if key != now:
                        close()
                    now, shift = key, r["shift"]
                windows.append((r["q"], r["kinds"], r["item_values"], r["doc_values"]))
            if len(out[0]) > 10_000:
                yield A.rows(_LEAK, dict(zip(_LEAK.names, out, strict=True)))
                out = [[] for _ in _LEAK.names]
        settle()
        close()
        yield A.rows(_LEAK, dict(zip(_LEAK.names, out, strict=True)))

    return run


def _needed(cut: DataFrame, width: int, share: float) -> DataFrame:
    """``template, most``: the windows that more than ``most`` templates hold cover less than ``share`` of the template's item.

    A token lies in such a window if the most shared window over it is one; ``most`` is how shared that is for the last token needed."""
    over = F.max("held").over(W.partitionBy("template").orderBy("at").rowsBetween(1 - width, 0))
    at = F.when(F.col("q") == F.col("n") - F.abs("size"), F.sequence("q", F.col("n") - 1)).otherwise(F.array("q"))
    places = cut.select("template", "n", "q", "held", F.explode(at).alias("at"))
    places = places.select("template", "n", "at", F.when(F.col("at") == F.col("q"), F.col("held")).alias("held"))
    nth = F.row_number().over(W.partitionBy("template").orderBy(F.col("over").desc()))
    ranked = places.withColumn("over", over).withColumn("nth", nth)
    return ranked.filter(F.col("nth") == F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(share)))).select("template", F.col("over").alias("most"))


def templates(benchmark: DataFrame, width: int = 8, plain: int = 3, shared: int | None = 16, share: float = 0.5) -> DataFrame:
    """Windows of the templates: ``template, item_id, n_items, n, size, q, hash, first, kinds, item_values, starts``."""
    items = A.with_text(benchmark.filter("item_id is not null"), "item_id").select(F.col("item_id").cast("long"), "text").dropDuplicates()
    cut = cut_lineage(items.mapInArrow(_items(width, plain), _WINDOW_DDL))
    chief = cut.filter("q = 0").groupBy("template").agg(F.min(F.struct("item_id", "text_key")).alias("chief"), F.count("*").alias("n_items"))
    cut = cut.join(chief, "template").filter("item_id = chief.item_id and text_key = chief.text_key").drop("chief", "text_key")
    held = cut.select("hash", "template").distinct().groupBy("hash").agg(F.count("*").alias("held"))
    cut = cut.dropDuplicates(["template", "q"]).join(held, "hash")
    if shared is None:
        cut = cut_lineage(cut)
        needed = _needed(cut, width, share)
        return cut.join(needed, "template", "left").withColumn("starts", F.coalesce(F.col("held") <= F.col("most"), F.lit(False))).drop("held", "most")
    rarest = F.row_number().over(W.partitionBy("template").orderBy("held", F.col("q").desc())) == 1
    return cut.withColumn("starts", (F.col("held") <= shared) | rarest).drop("held")


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8, plain: int = 3, share: float = 0.5, shared: int | None = 16, bits: int = 25) -> DataFrame:
    """``doc_id, item_id, n_matched, n_item, first_word, n_items`` of every template that a document holds, named by its least item."""
    spark = docs.sparkSession
    windows = cut_lineage(templates(benchmark, width, plain, shared, share))
    sizes = sorted(r.size for r in windows.select("size").distinct().collect())  # two for each length up to ``width`` at most
    bitmap = spark.sparkContext.broadcast(A.bitmap_of(windows, "hash", bits))
    texts = A.with_text(docs, "doc_id").select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long"), "text")
    hits = cut_lineage(texts.mapInArrow(_hits(sizes, bitmap), _HIT_DDL))
    agree = (F.col("size") < 0) | (F.col("first") == F.col("doc_first")) | (F.substring("item_values", 1, 8) == F.substring("doc_values", 1, 8))
    shift = F.col("p") - F.col("q")
    met = hits.join(windows.filter("starts"), "hash").filter(agree).withColumn("shift", shift)
    once = hits.dropDuplicates(["row", "hash", "p"])
    if shared is None:  # the template may stand at other places of the document by its other windows alone
        full = cut_lineage(met.select("row", "template").distinct()).join(windows, "template")
        full = full.join(once, ["row", "hash"]).filter(agree).withColumn("shift", shift)
    else:
        places = cut_lineage(met.select("row", "template", "shift").distinct())
        full = places.join(windows, "template").withColumn("p", F.col("shift") + F.col("q"))
        full = full.join(once, ["row", "hash", "p"]).filter(agree)
    cols = ["row", "template", "shift", "q", "doc_id", "item_id", "n", "n_items", "kinds", "item_values", "doc_values"]
    dealt = full.select(*cols).repartition(A.n_buckets(spark), "row", "template").sortWithinPartitions("row", "template", "shift", "q")
    out = dealt.mapInArrow(_judge(share), _LEAK_DDL)
    return out.groupBy("doc_id", "item_id").agg(F.max("n_matched").alias("n_matched"), F.max("n_item").alias("n_item"), F.min("first_word").alias("first_word"), F.max("n_items").alias("n_items"))
