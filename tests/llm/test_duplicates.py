import hashlib
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from tallybook.llm import common, neardup, repeats
from tallybook.llm.decontam import leaks
from tallybook.llm.neardup import near_duplicates
from tallybook.llm.repeats import remove_repeats
from tests.llm.conftest import messy_rows

WORD = r"[^\x20\x09-\x0D]+"


def components_of(rows):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(WORD, re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None:
                n = len(sets[a] & sets[b])
                if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                    root[find(a)] = find(b)
    low = defaultdict(lambda: 10**9)
    for k, r in enumerate(rows):
        if r[0] is not None:
            low[find(k)] = min(low[find(k)], r[0])
    return sorted(((r[0], len(sets[k]), low[find(k)] if r[0] is not None else None) for k, r in enumerate(rows)), key=str)


def found(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect()), key=str)


def test_near_duplicates(messy):
    assert found(near_duplicates(messy)) == components_of(messy_rows())
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in near_duplicates(messy).collect())


def test_links_that_hubs_do_not_show(spark, monkeypatch):
    """Chains, blocks of two rows: members linked with each other and not with the hub are still joined."""
    monkeypatch.setattr(neardup, "CHUNK", 2)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[9 * k : 9 * k + 80])) for k in range(30)] + [(100 + k, " ".join(words[300 + k : 390 + k])) for k in range(10)]
    rows += [(200, rows[3][1]), (201, "w1 w2"), (202, "w1 w2")]
    assert found(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == components_of(rows)


def test_links_in_a_block_whose_hub_shows_none():
    """Sets of 20 to 1000 hashes from the whole 64-bit range: the pairs of 76 % are linked, with the hub and with others nobody is."""
    rng = np.random.default_rng(4)
    draw = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    sets, linked = [draw(300)], set()
    for n in (20, 27, 400, 1000):
        a = draw(n)
        sets += [a, np.concatenate([a[: n - n // 8], draw(n // 8)])]
        linked.add((len(sets) - 2, len(sets) - 1))
    sets += [np.concatenate([sets[-1][:700], draw(300)])]  # under 75 %
    rows = [(b"%d" % k, s) for k, s in enumerate(sets)]
    shown = [(outside, d, np.sort(s).view(np.int64), neardup.odd_sketch(neardup.samples(s)).view(np.int64)) for outside in (True, False) for d, s in rows if d != b"0" or not outside]
    block = pd.DataFrame([{"outside": o, "digest": d, "label": d, "shingles": s, "sketch": k} for o, d, s, k in shown])
    links = neardup.links_in_block(neardup.PERCENT)(block)
    assert {tuple(sorted((int(a), int(b)))) for a, b in zip(links["a"], links["b"])} == linked


def test_screen_lets_similar_sets_through():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = rng.integers(0, 2**63, 700, dtype=np.uint64)
        b = np.concatenate([a[:600], rng.integers(0, 2**63, 100, dtype=np.uint64)])  # 75 %
        x, y = (neardup.odd_sketch(neardup.samples(s)) for s in (a, b))
        assert sum(int(v).bit_count() for v in x ^ y) <= neardup.xor_limit(neardup.SCREEN)


def test_components(spark):
    links = [(b"%04d" % k, b"%04d" % (k + 1)) for k in range(40)] + [(b"x", b"y"), (b"y", b"x"), (b"0100", b"0007")]
    got = {bytes(r.node): bytes(r.label) for r in common.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert got[b"0040"] == got[b"0100"] == b"0000" and got[b"y"] == b"x" and len(got) == 44


def removed_of(rows, size=20):
    first, words = {}, []
    order = sorted((k for k in range(len(rows)) if rows[k][0] is not None), key=lambda k: rows[k][0])
    for _, t, *_ in rows:
        words.append(re.findall(WORD, t or ""))
    for k in order:
        for s in range(len(words[k]) - size + 1):
            place = (rows[k][0], s)
            key = tuple(words[k][s : s + size])
            first[key] = min(first.get(key, place), place)
    out = []
    for k, r in enumerate(rows):
        gone = set()
        if r[0] is not None:
            for s in range(len(words[k]) - size + 1):
                if first[tuple(words[k][s : s + size])] < (r[0], s):
                    gone.update(range(s, s + size))
        text = " ".join(w for j, w in enumerate(words[k]) if j not in gone)
        out.append((r[0], len(words[k]), len(gone), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def removed(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("group", [1024, 2])
def test_repeats(messy, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    assert removed(remove_repeats(messy)) == removed_of(messy_rows())


@pytest.mark.parametrize("group", [1024, 8, 2])
def test_shared_passages(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = np.random.default_rng(5)
    draw = lambda n: [f"v{x}" for x in rng.integers(0, 50, n)]
    passage, line = draw(70), draw(12)
    rows = [(int(k), " ".join([*draw(int(rng.integers(0, 60))), *(passage if k % 3 else passage[20:50]), *line, *draw(30), *line])) for k in rng.permutation(40)]
    assert removed(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == removed_of(rows)


def test_one_common_line_and_passage(spark, monkeypatch):
    """A line of few words and a passage in every document, between words of its own, and a document that repeats itself."""
    monkeypatch.setattr(repeats, "GROUP", 16)
    rng = np.random.default_rng(6)
    own = lambda k, n: [f"w{k}_{j}" for j in range(n)]
    passage, line = [f"p{j}" for j in range(40)], [f"l{j}" for j in range(11)]
    rows = [(int(k), " ".join([*own(k, int(rng.integers(0, 15))), *passage, *own(-k, 25), *line, *own(k + 999, 12)])) for k in rng.permutation(300)]
    rows += [(5000, "so it goes " * 40), (5001, " ".join(passage[10:35]))]
    assert removed(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == removed_of(rows)
    strings = spark.createDataFrame([(1, b"%d" % k, 0, k, 0, " ".join([*own(k, 5), *passage]).encode()) for k in range(200)], "bucket long, digest binary, offset int, doc_id long, start int, packed binary")
    found = repeats.repeats_in_buckets(strings, 20, group=16).collect()
    assert sorted((bytes(r.digest), r.offset) for r in found) == sorted((b"%d" % k, o) for k in range(1, 200) for o in range(5, 26))


def test_leaks(spark, nothing):
    item = "If Anna buys 12 apples and 7 pears at 3 dollars each in Paris, how much money does Anna pay for all the fruit she takes home?"
    items = [(1, item), (2, "Name the capital of France please now"), (3, None), (4, ""), (5, "1 2 3 4 5 6 7 8 9 10"), (6, "yes")]
    changed = item.replace("Anna", "Boris").replace("12", "31").replace(" 3 dollars", " 9 euros").replace("Paris", "Rome")
    torn = item.replace("Anna", "Boris", 1)  # one name, two values: not the same question, but 25 of its words in a row
    pad = "Some other words stand here before anything of interest comes along in this text. "
    docs = [
        (10, pad + item + " " + pad), (11, pad + changed), (12, pad), (13, None), (14, ""), (15, pad + torn), (16, "3 4 5 6 7 8 9 10 11 12"), (None, item),
        (17, "name the CAPITAL of (France) please, now"), (10, pad + item + " " + pad), (18, "0 1 2 3 4 5 6 7 8 9 10 11"), (19, "yes"), (20, pad.upper() + item.upper()),
        (21, "ÉTÉ À L'ÎLE: ÖL, ÑANDÚ ET ÇA ΣΑΜΟΣ МИР İ"),
    ]
    items.append((7, "Été à l'île: öl, ñandú et ça σαμοσ мир İ"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark)
    more = [(21, 7, False), (20, 1, False), (15, 1, False)]
    assert sorted(((r.doc_id, r.item_id, r.reparameterised) for r in got.collect()), key=str) == sorted(
        [(10, 1, False), (11, 1, True), (None, 1, False), (17, 2, False), (16, 5, False), (18, 5, False)] + more, key=str
    )
    assert leaks(nothing, benchmark).count() == 0
    assert leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark.limit(0)).count() == 0


def test_leaks_of_items_that_open_with_names(spark):
    item = "Tom has 5 red apples. Tom buys 3 more apples. Tom eats 2 of them. How many are left?"
    ann = item.replace("Tom", "Ann").replace("5", "8").replace("3", "4").replace("2", "6")
    docs = [(1, "Some words before. " + ann), (2, ann.replace("Ann", "Eve", 1)), (3, "Question: " + item), (4, "so " + ann[0].lower() + ann[1:])]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {(r.doc_id, r.n_windows, r.reparameterised) for r in got.where("doc_id in (1, 3)").collect()} == {(1, 12, True), (3, 12, False)}
    assert got.where("doc_id = 2").count() == 0


def test_leaks_of_parts(spark):
    """22 consecutive words of a long item, and a short one with a word put in; 12 words of the long one are too few."""
    words = [f"w{chr(97 + k // 8)}{chr(97 + k % 8)}" for k in range(59)]
    short = [f"v{chr(97 + k)}" for k in range(20)]
    pad = "other words here " * 4
    docs = [(1, pad + " ".join(words[20:42]) + " " + pad), (2, " ".join([*short[:10], "very", *short[10:]])), (3, pad + " ".join(words[20:32])), (4, pad + " ".join(words[20:33]))]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(words)), (2, " ".join(short))], "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.n_windows, r.reparameterised) for r in got.collect()} == {(1, 1, 15, False), (2, 2, 6, False), (4, 1, 6, False)}


def test_no_rows(nothing):
    assert near_duplicates(nothing).count() == 0 and remove_repeats(nothing).count() == 0
