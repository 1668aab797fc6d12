"""Decontamination against a brute-force version of its rule, and openings that very many items share."""

import random
import time
from collections import Counter, defaultdict

from repolore.llm import decontaminate

DDL = "doc_id long, text string, row long, template long, hash long, q string"


def windows_of(text, width, plain):
    h, kind, value = (x.tolist() for x in decontaminate.tokens(text))
    n, out = len(h), []
    size = min(width, n)
    for q in range(n - size + 1 if n else 0):
        ordinary = sum(k == decontaminate.PLAIN for k in kind[q : q + size])
        by_template = ordinary >= min(plain, size) and size > 1
        out.append((q, size, ("t", size, *h[q + 1 : q + size]) if by_template else ("v", size, *value[q : q + size])))
    return out, h, kind, value


def brute(texts, items, width=8, plain=3, share=0.5, shared=16):
    groups = defaultdict(list)
    for item, text in dict.fromkeys(items):
        if item is not None and text and (cut := windows_of(text, width, plain))[0]:
            w, h, kind, value = cut
            slots = [value[i] for i in range(len(h)) if kind[i] != decontaminate.PLAIN]
            groups[tuple(w), tuple(kind), tuple(map(slots.index, slots))].append((item, text))
    chosen = {k: min(v) for k, v in groups.items()}
    held = Counter(key for w, _, _ in groups for key in {x[2] for x in w})
    out = []
    for doc, text in texts:
        _, dh, _, dv = windows_of(text, width, plain)
        for group, (item, item_text) in chosen.items():
            w, h, kind, value = windows_of(item_text, width, plain)
            rarest = min(w, key=lambda x: (held[x[2]], -x[0]))

            def fits(x, shift, h=h, value=value, dh=dh, dv=dv):
                q, size, key = x
                p = q + shift
                if p < 0 or p + size > len(dh):
                    return False
                if key[0] == "v":
                    return tuple(dv[p : p + size]) == key[2:]
                return tuple(dh[p + 1 : p + size]) == key[2:] and (dh[p] == h[q] or dv[p] == value[q])

            covered, first = set(), None
            for shift in range(-len(h), len(dh)):
                if not any(fits(x, shift) for x in w if held[x[2]] <= shared or x is rarest):
                    continue
                here = [x for x in w if fits(x, shift)]
                slot = {q + i: (kind[q + i], value[q + i], dv[q + i + shift]) for q, size, _ in here for i in range(size) if kind[q + i] != decontaminate.PLAIN}
                pair, left, right = Counter(slot.values()), Counter(x[:2] for x in slot.values()), Counter((x[0], x[2]) for x in slot.values())
                found = set()
                for q, size, _ in here:
                    same = value[q : q + size] == dv[q + shift : q + shift + size]
                    if same or all(i not in slot or 2 * pair[slot[i]] > max(left[slot[i][:2]], right[slot[i][0], slot[i][2]]) for i in range(q, q + size)):
                        found |= set(range(q, q + size))
                if found:
                    covered |= found
                    first = min(x for x in (first, shift + min(found)) if x is not None)
            if covered and len(covered) >= share * len(h):
                out.append((doc, item, len(covered), len(h), first, len(groups[group])))
    return sorted(out, key=str)


def sentence(rnd, n):
    words = ["apples", "market", "bought", "walked", "river", "old", "stone", "Anna", "Peter", "Maria", "12", "7", "kg", "km", "the", "of", "and"]
    return " ".join(rnd.choice(words) for _ in range(n))


def test_against_brute_force(spark):
    rnd = random.Random(3)
    opening = "read the following text with care and answer the question that"
    items = [(i, sentence(rnd, rnd.randint(1, 25))) for i in range(40)]
    items += [(100 + i, f"{opening} {sentence(rnd, 6)}") for i in range(30)] + [(7, None), (8, ""), (None, "no id at all"), items[3], (300, items[3][1])]
    items += [(400 + i, f"Anna bought {i} kg of old apples and walked {i} km to the river with Peter") for i in range(5)]
    texts = []
    for _ in range(25):
        part = rnd.choice(items)[1] or ""
        part = part.replace("Anna", rnd.choice(["Anna", "Lena", "Vera"])).replace("12", rnd.choice(["12", "15"]))
        words = part.split(" ")
        if words and rnd.random() < 0.4:
            words[rnd.randrange(len(words))] = rnd.choice(["Maria", "99", "stone"])
        texts.append(f"{sentence(rnd, 12)} {' '.join(words)} {sentence(rnd, 12)}")
    texts += [opening * 3, "Lena bought 5 kg of old apples and walked 5 km to the river with Otto", "Lena bought 5 kg of old apples and walked 6 km to the river with Otto", None, "", "x"]
    rows = [(i, t) for i, t in enumerate(texts)]
    for options in ({}, {"shared": 2}, {"width": 4, "plain": 1}):
        docs = spark.createDataFrame([(*r, 1, 2, 3, "q") for r in rows], DDL).repartition(3)
        got = decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("x", "y"), **options).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, items, **options)


def test_an_opening_that_many_items_share_is_no_leak(spark):
    opening = "read the passage below with care and then give an answer"
    items = spark.range(20_000).selectExpr("id as item_id", f"concat('{opening}', ' about q', id, 'x') as text")
    texts = [(0, f"{opening} " * 20), (1, f"{opening} about q77x now")]
    start = time.time()
    found = decontaminate.leaks(spark.createDataFrame(texts, "doc_id long, text string"), items).collect()
    assert [(r.doc_id, r.item_id, r.n_matched) for r in found] == [(1, 77, 13)] and time.time() - start < 30


def test_copies_of_an_item_are_one_leak(spark):
    items = spark.range(5_000).selectExpr("id as item_id", "'Anna bought 12 kg of red apples at the old market' as text")
    found = decontaminate.leaks(spark.createDataFrame([(1, "then Vera bought 9 kg of red apples at the old market")] * 3, "doc_id long, text string"), items).collect()
    assert [(r.doc_id, r.item_id, r.n_items) for r in found] == [(1, 0, 5_000)]
