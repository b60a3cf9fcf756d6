"""Spelling variants, conversation tries and language ids against brute force and held-out rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybook.llm.language import BUCKETS, LONGEST, Rows, fit, held_out, identify_languages, subword_counts
from tallybook.llm.spelling import BEFORE, BEHIND, Grams, corpus_words, count_grams, list_keys, near_words, one_edit, spelling_variants
from tallybook.llm.trie import prefix_trie, sequences, with_shared_heads
from tests.llm.conftest import messy_rows

# ---- spelling


def brute_words(rows, least=7, twice=2):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode()) if doc is not None else 1
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= least:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= twice}


def brute_variants(words, ratio=10):
    near = {w: [x for x in words if x != w and one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(((-words[x], x) for x in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= ratio * n else None
    rows = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(rows)


def grams_of(words, frequent):
    counts = Counter()
    for w in words:
        s = BEFORE + w + BEHIND
        counts.update(s[i : i + size] for size in (2, 3, 4, 5) for i in range(len(s) - size + 1))
    return Grams(counts, len(words), frequent, longest=5)


def test_affected_bounds_every_edit():
    rng = random.Random(3)
    letters = "abc"
    for frequent in (0.0, 0.02, 0.3):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 12))) for _ in range(300)]
        grams = grams_of(words, frequent)
        kept = lambda s: Counter(s[a:b] for a, b in grams.decompose(s))
        for w in words[:60]:
            s = BEFORE + w + BEHIND
            ranges = grams.decompose(s)
            bound = len(ranges) - grams.affected(s, ranges)
            mine = kept(s)
            for i in range(len(w) + 1):
                edits = [w[:i] + c + w[i:] for c in letters] + [w[:i] + w[i + 1 :]] + [w[:i] + c + w[i + 1 :] for c in letters if i < len(w)]
                for x in edits:
                    both = mine & kept(BEFORE + x + BEHIND)
                    assert sum(both.values()) >= bound
                    if x != w and max(bound, list_keys(x, grams)[1]) > 0:
                        assert set(list_keys(w, grams)[0]) & set(list_keys(x, grams)[0])


def test_spelling_against_brute_force(spark):
    rng = random.Random(5)
    words = {}
    for _ in range(500):
        w = "".join(rng.choice("abé") for _ in range(rng.randint(7, 9)))
        words[w] = rng.choice([2, 2, 3, 20, 21, 30, 250, 3000])
    words |= {"a" * 7: 2, "a" * 8: 20, "a" * 9: 200, "x" * 80: 2, "x" * 81: 20, "x" * 40 + "y" + "x" * 40: 300, "ligatureœ": 5}
    table = spark.createDataFrame([*words.items(), (None, 7)], "word string, n long")
    split = table.unionByName(table.where("word = 'aaaaaaa'").withColumn("n", F.lit(0).cast("long")))  # a word in two rows is added up
    assert sorted(map(tuple, spelling_variants(split).collect())) == brute_variants(words)
    pairs = {(a, b) for a in words for b in words if a != b and one_edit(a, b)}
    assert {(r.word, r.near) for r in near_words(table.where("word is not null")).collect()} == pairs


def test_words_of_messy_documents(spark, messy, nothing):
    rows = [(r[0], r[1]) for r in messy_rows()]
    assert {r.word: r.n for r in corpus_words(messy).collect()} == brute_words(rows)
    assert {r.word: r.n for r in corpus_words(messy, least_length=3, least_count=1, typo_every=None).collect()} == {
        w: n for w, n in Counter(x.lower() for _, t in rows for x in re.findall("[A-Za-zÀ-ÿ]+", t or "") if len(x) >= 3).items()
    }
    assert spelling_variants(corpus_words(nothing)).collect() == []
    assert sorted(map(tuple, spelling_variants(corpus_words(messy)).collect())) == brute_variants(brute_words(rows))


# ---- trie


def brute_trie(turns, family=20, heads=4):
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    plain = {c: [(r, t) for _, _, r, t in sorted(rows)] for c, rows in own.items()}
    rebuilt = {}
    for c in plain:
        h = zlib.crc32(str(c).encode()) % heads
        rebuilt[c] = plain.get(c - c % family, [])[:h] + plain[c][h:]
    members = defaultdict(list)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        words = len(re.findall("[^\x20\x09-\x0d]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * words
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(k))
        parent = min(members[k[:-1]]) if k else None
        out.append((min(m), len(k), parent, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(turns, block_rows):
    return sorted(map(tuple, prefix_trie(with_shared_heads(sequences(turns)), block_rows).collect()), key=str)


@pytest.mark.parametrize("block_rows", [2, 7, 1 << 16])
def test_trie_against_brute_force(spark, block_rows):
    rng = random.Random(block_rows)
    turns = []
    for conv in rng.sample(range(400), 150):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9])):
            turns.append((conv, turn, rng.choice(["user", "user", None, ""]), rng.choice(["a", "a", "b c", None, " ", "d e f"])))
    turns += [(conv, t, "user", "the same long talk") for conv in range(1000, 1060) for t in range(3)]  # many copies over many blocks
    turns += [(7000, t, "user", str(t)) for t in range(300)] + [(None, 1, "user", "lost"), (45, None, "user", "first"), (7001, 0, "user", "0")]
    seen = set()
    turns = [t for t in turns if not (t[:2] in seen or seen.add(t[:2]))]  # ties of turn are ordered by token
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("key", F.lit("x"))
    assert trie_rows(df, block_rows) == brute_trie(turns)


def test_trie_of_few_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie_rows(spark.createDataFrame([], schema), 4) == []
    alone = [(20, 0, "u", "one two")]
    assert trie_rows(spark.createDataFrame(alone, schema), 4) == brute_trie(alone)
    short = [(c, 0, "u", "gone") for c in range(1, 12)]  # with more shared turns than own ones nothing is left
    assert any(len(r) and r[1] == 0 for r in brute_trie(short))
    assert trie_rows(spark.createDataFrame(short, schema), 2) == brute_trie(short)
    tied = spark.createDataFrame([(1, 0, "u", "x"), (1, 0, "u", "y"), (2, 0, "u", "y"), (2, 0, "u", "x"), (1, 0, "u", "x")], schema)
    nodes = prefix_trie(sequences(tied)).collect()  # ties of turn are ordered by token; repeated rows are turns of their own
    assert max(r.depth for r in nodes) == 3 and min(r.n_convs for r in nodes if r.depth == 1) >= 1


# ---- languages


def test_subwords_of_pieces(monkeypatch):
    import tallybook.llm.language as language

    text = "Añb 12 cd--e" * 40 + "中文" * 9
    whole, n = subword_counts(text)
    assert n == sum(c.isalpha() for c in text.lower())
    signs = "\0" + re.sub("\0+", "\0", "".join(c if c.isalpha() else "\0" for c in text.lower())) + "\0"
    signs = re.sub("\0+", "\0", signs)
    count = sum(
        1 for size in range(1, LONGEST + 1) for i in range(len(signs) - size + 1)
        if "\0" not in signs[i + 1 : i + size - 1] and signs[i : i + size].strip("\0")
    )
    assert whole.sum() == count
    assert subword_counts("")[1] == 0 and subword_counts("12 ?!")[1] == 0


def test_language_of_held_out_rows(spark, messy, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    unseen = [r for r in got if r.held_out]
    assert len(got) == docs.count() and len(unseen) > 200
    assert np.mean([r.lang == r.lang_pred for r in unseen]) > 0.97
    accepted = [r for r in unseen if r.accepted]
    assert len(accepted) > 0.8 * len(unseen) and np.mean([r.lang == r.lang_pred for r in accepted]) > 0.99
    assert {r.doc_id for r in got if r.held_out} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert all(0 <= r.score <= 1 for r in got)
    again = {r.doc_id: (r.lang_pred, r.score) for r in identify_languages(docs.repartition(5)).collect()}
    assert again == {r.doc_id: (r.lang_pred, r.score) for r in got}


def test_language_of_messy_rows(spark, messy, nothing):
    rows = identify_languages(messy).collect()
    assert len(rows) == len(messy_rows())
    for r in rows:
        texts = [t for i, t, *_ in messy_rows() if i == r.doc_id]
        if r.doc_id is not None and all(not any(c.isalpha() for c in t or "") for t in texts):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
        elif r.doc_id is not None:
            assert r.lang_pred == "en"
    assert identify_languages(nothing).collect() == []
    unlabelled = messy.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in identify_languages(unlabelled).collect()} == {"und"}


def test_rejection_of_foreign_text():
    rng = np.random.default_rng(1)
    word = lambda letters: "".join(rng.choice(list(letters), rng.integers(2, 8)))
    texts, labels = [], []
    for k in range(400):
        name, letters = ("aa", "aeionst") if k % 2 else ("uu", "uklmrvz")
        texts.append(" ".join(word(letters) for _ in range(rng.integers(1, 40))))
        labels.append(name)
    counted = [subword_counts(t) for t in texts]
    rows = Rows([np.flatnonzero(c) for c, _ in counted], [c[c > 0].astype(np.float32) for c, _ in counted])
    model = fit(rows, labels, np.array([n for _, n in counted], float))
    score = lambda t: model.probabilities(model.logits(subword_counts(t)[0][None, :]), np.array([subword_counts(t)[1]], float)).max()
    assert score(" ".join(word("aeionst") for _ in range(30))) >= model.threshold
    assert score("g") < score(" ".join(word("uklmrvz") for _ in range(30)))
    assert BUCKETS == len(counted[0][0])
