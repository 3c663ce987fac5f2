"""Cases of the operators for training data that need a fixture of their own: odd ids, long runs, minority lengths."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from focalgrid.llm import decontaminate, embedding_dedup, line_dedup, secrets, substring_dedup, warc
from focalgrid.llm import text as tx
from focalgrid.llm import toxicity

WORDS = [a + b for a in ("ba", "de", "ki", "lo", "mu", "na", "po", "ri") for b in ("ta", "se", "vi", "zo", "lu", "fe")]


def test_words_in_pieces_are_the_same(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS, k=200)), "x" * 700, "", "a\tb " + "y" * 300]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = tx.words(data, offsets, tx.tables())
    monkeypatch.setattr(tx, "CHUNK", 256)
    for a, b in zip(whole, tx.words(data, offsets, tx.tables())):
        assert (a == b).all()


def test_largest_and_null_ids_of_passages(spark):
    text = " ".join(WORDS[:20])
    rows = [(1, text), (2**63 - 1, text), (None, text), (5, None)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2**63 - 1: 20, None: 0, 5: 0}


def test_vectors_of_two_lengths(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (2, [1.0, 0.01, 0.0], 0), (3, [0.0, 1.0, 0.0], 0), (4, [1.0, 2.0], 0), (5, [1.0, 2.0], 0), (6, [2.0, 4.1], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (0, 6)}


def test_rare_vector_pairs_without_any_in_the_sample(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6000, 32))
    unit = base[:300] / np.linalg.norm(base[:300], axis=1, keepdims=True)
    near = np.concatenate([embedding_dedup.partners(unit[i::3], c, i) for i, c in enumerate((0.931, 0.945, 0.96))])
    every = np.concatenate([base, near])
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    true = (np.triu(unit @ unit.T, 1) >= 0.93).sum() * 2
    d = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(every)], "vec_id long, embedding array<double>, label int")
    found = embedding_dedup.near_vectors(d, max_sample=256).agg(F.sum("n_links")).first()[0]
    assert 0.95 * true <= found <= true


def test_a_long_run_of_letters_takes_seconds(spark):
    rng = random.Random(2)
    run = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=300_000))
    began = time.time()
    got = secrets.find_secrets(spark.createDataFrame([(1, run)], "doc_id long, text string")).first()
    assert got.entropy and time.time() - began < 60


def test_few_earlier_lines_settle_the_same_lines(spark):
    rng = random.Random(4)
    base = [rng.choices(WORDS, k=rng.randint(3, 60)) for _ in range(12)]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(rng.randint(0, 4)):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            lines.append(rng.choice(["", " ", "\t"]).join(["", " ".join(w)]))
        rows.append((rng.choice([i, i, 7, None]), "\n".join(lines)))
    d = spark.createDataFrame([*rows, (-5, " ".join(base[0])), (2**62, " ".join(base[1]))], "doc_id long, text string")
    every = {r.doc_id: r.removed for r in line_dedup.removed_lines(d).collect() if r.removed}
    assert every == {r.doc_id: r.removed for r in line_dedup.repeated_lines(d).collect()}


def test_links_of_near_copies_are_counted_without_their_pairs(spark, monkeypatch):
    rng = random.Random(9)
    base, other = [f"b{i}" for i in range(60)], [f"c{i}" for i in range(30)]
    lines = []
    for i in range(160):
        w = list(base if i % 8 else other)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 5, 6, 9])):
            w[rng.randrange(len(w))] = rng.choice([f"n{rng.randrange(900)}", f"s{rng.randrange(6)}"])
        lines.append(" ".join(w + rng.choices(["s1", "s2", f"m{i}"], k=rng.randrange(6))))
    lines += [lines[1], lines[2].upper(), " ".join(base[:49]), " ".join(base[:40] + other[:5]), "b1"]
    rng.shuffle(lines)
    sets = {x: set(x.lower().split()) for x in lines}
    alike = {x: [y for y in sets if y != x and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]) - 1e-9] for x in sets}
    want = {i: (len(alike[x]), [0] if any(y == x or y in alike[x] for y in lines[:i]) else []) for i, x in enumerate(lines)}
    taken, verified = [], line_dedup.Prepared.verified
    monkeypatch.setattr(line_dedup.Prepared, "verified", lambda p, pairs: taken.append(pairs.count()) or verified(p, pairs))
    d = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: (r.n_links, r.removed) for r in line_dedup.removed_lines(d).collect()}
    assert {i: got.get(i, (0, [])) for i in want} == want
    assert sum(n for n, _ in want.values()) > 10_000 and sum(taken) < 2_000


def test_lines_at_the_edges_of_a_group_are_of_one_group(spark, monkeypatch):
    rng = random.Random(21)
    base, lines = [f"b{i}" for i in range(60)], []
    for i in range(240):
        w = list(base)
        for k in rng.sample(range(60), 5 if i % 3 else 1):
            w[k] = f"n{i}x{k}"
        lines.append(" ".join(w))
    sets = [set(x.split()) for x in lines]
    alike = [[j for j, y in enumerate(sets) if j != i and len(x & y) >= 0.8 * len(x | y) - 1e-9] for i, x in enumerate(sets)]
    taken, verified = [], line_dedup.Prepared.verified
    monkeypatch.setattr(line_dedup.Prepared, "verified", lambda p, pairs: taken.append(pairs.count()) or verified(p, pairs))
    # the last two rows share an id and a place, so a line is not told by its place
    rows = [*enumerate(lines), (999, lines[0] + " z"), (999, "q r s")]
    got = {r.doc_id: (r.n_links, r.removed) for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    more = sets[0] | {"z"}
    last = [i for i, x in enumerate(sets) if len(x & more) >= 0.8 * len(x | more) - 1e-9]
    want = {i: (len(found) + (i in last), [0] if min(found, default=i) < i else []) for i, found in enumerate(alike)} | {999: (len(last), [0])}
    assert {i: got.get(i, (0, [])) for i in want} == want
    print("pairs", sum(taken), "links", sum(n for n, _ in want.values()))
    assert sum(n for n, _ in want.values()) > 20_000 and sum(taken) < 1_000


def test_lines_with_columns_of_the_operators_names(spark):
    d = spark.createDataFrame([(1, "a b c", 5, "x", "y"), (2, "a b c\nq", 6, "z", None)], "doc_id long, text string, doc int, removed string, Doc_ string".replace("Doc_", "place"))
    assert sorted(tuple(r) for r in line_dedup.dedup_lines(d).collect()) == [(1, "a b c", 5, "x", "y"), (2, "q", 6, "z", None)]


def test_archives_of_large_pages_and_pages_without_id(spark, tmp_path):
    big = "p" * 70_000
    rows = [(None, "u", "n" * 200), (None, "u", "n" * 200), (3, "u", big), (9, "u", big), (4, None, "é" * 50), (8, "", "é" * 50), (5, "u", None)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert sorted(((r.page_id or 0), r.payload_bytes, r.record_type, r.refers_to or 0) for r in got) == sorted([(0, 200, "response", 0), (0, 200, "response", 0), (3, 70_000, "response", 0), (9, 70_000, "revisit", 3), (4, 100, "response", 0), (8, 100, "revisit", 4), (5, 0, "response", 0)])
    assert all(r.sound for r in got)


def edit_distance_within(item: str, text: str) -> int:
    """The fewest edits between an item and any stretch of a text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_leaks_by_scanning_all_pairs(spark):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choices(WORDS, k=14))) for i in range(6)] + [(90, "tiny")]
    docs = []
    for i in range(40):
        words = rng.choices(WORDS, k=30)
        if i % 2:
            held = list(rng.choice(items[:6])[1])
            for _ in range(rng.randint(0, 6)):
                held[rng.randrange(len(held))] = rng.choice("abc")
            words.insert(rng.randrange(30), "".join(held))
        docs.append((i, " ".join(words)))
    docs += [(100, " Tiny "), (101, "tiny but not alone")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()}
    want = {(100, 90)}
    for doc_id, text in docs[:40]:
        for item_id, item in items[:6]:
            m = len(item)
            if edit_distance_within(item, text) <= min(int(m * 0.05), (m - 12) // 12):
                want.add((doc_id, item_id))
    assert got == want
    # in several blocks, each a pass of its own
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b, block_bytes=200).collect()} == want


def test_leaks_with_a_tenth_of_edits_by_scanning_all_pairs(spark):
    rng = random.Random(7)
    items = [(i, " ".join(rng.choices(WORDS, k=k))) for i, k in enumerate((3, 4, 6, 9, 14, 20))]
    docs = []
    for i in range(60):
        words = rng.choices(WORDS, k=30)
        if i % 2:
            held = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 2 + len(held) // 9)):
                at = rng.randrange(len(held))
                held[at : at + 1] = rng.choice(["", "q", "zz"])
            words.insert(rng.randrange(30), "".join(held))
        docs.append((i, " ".join(words)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.leaks(d, b, edit_share=0.1, q=8).collect()}
    want = {}
    for doc_id, text in docs:
        for item_id, item in items:
            m, least = len(item), edit_distance_within(item, text)
            if m >= 8 and least <= min(int(m * 0.1), (m - 8) // 8):
                want[doc_id, item_id] = least
    assert got.keys() == want.keys() and max(want.values()) >= 5
    assert {r.doc_id for r in decontaminate.drop_leaks(d, b, edit_share=0.1, q=8).collect()} == {x for x, _ in docs} - {x for x, _ in want}


def test_ftrl_follows_the_dense_formula():
    rng = np.random.default_rng(0)
    samples = [np.unique(rng.integers(0, 16, 5)) for _ in range(60)]
    labels = np.array([float(0 in s or 3 in s) for s in samples])
    alpha, beta, l1, l2 = 0.5, 1.0, 0.3, 0.2
    z, n = np.zeros(16), np.zeros(16)
    rate = labels.mean()
    bias, bias_n = np.log(rate / (1 - rate)), 1.0

    def weights():
        return np.array([0.0 if abs(a) <= l1 else -(a - np.sign(a) * l1) / ((beta + np.sqrt(b)) / alpha + l2) for a, b in zip(z, n)])

    for _ in range(2):
        for ids, y in zip(samples, labels):
            w = weights()
            g = 1 / (1 + np.exp(-(w[ids].sum() + bias))) - y
            for i in ids:
                step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
                z[i] += g - step * w[i]
                n[i] += g * g
            bias_n += g * g
            bias -= alpha / (beta + np.sqrt(bias_n)) * g
    got, got_bias = toxicity.ftrl(samples, labels, 4, alpha, beta, l1, l2, 2)
    assert np.allclose(got, weights()) and np.isclose(got_bias, bias)


@pytest.mark.parametrize("pattern", ["hex", "access"])
def test_base_patterns_keep_the_contract(spark, pattern):
    rng = random.Random(8)
    texts = ["".join(rng.choices("abf0AKI9Z ", k=rng.randint(0, 200))) + rng.choice(["", "AKIA", "AKIA" + "Q" * 15, "AKIA" * 6, "0a" * 12, "0a" * 11]) for _ in range(80)]
    wanted = {"hex": (r"[0-9a-f]+", 24), "access": (r"AKIA[A-Z0-9]+", 20)}[pattern]
    got = {r.doc_id: [(s.start, s.end) for s in r.base if s.kind == pattern] for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [m.span() for m in re.finditer(wanted[0], t) if m.end() - m.start() >= wanted[1]]
