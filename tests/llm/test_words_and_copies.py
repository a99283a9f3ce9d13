"""Spelling variants, the cuckoo-filter index and token alignment against brute force."""

import hashlib
import random
import re
from collections import Counter
from itertools import product
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarmac.llm import cuckoo_dedup, spelling_variants, token_alignment
from tarmac.llm.cuckoo_dedup import CuckooFilter, CuckooIndex

ODD = [None, "", " \n\t ", "a", "É é", "x" * 30_000, "one two " * 4_000, "tab\tand\x0bfeed\x0c\r\n end", "日本語 テキスト 😀",
       "a b c d e a b c d e", "  lead", "trail  ", "a\x1cb \x7f c d\u0085e"]


def frame(spark, rows):
    extra = "doc_id bigint, text string, word string, n bigint, sha string, shard int, pair bigint, f bigint, _d bigint, key string"
    return spark.createDataFrame([(*r, "w", 1, "s", 2, 3, 4, 5, "k") for r in rows], extra)


# ---- op11 ----

def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and is_near(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def spelling_rows():
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcdeé÷") for _ in range(rng.choice([6, 6, 7, 8]))) for _ in range(60)]
    rows = []
    for i in range(900):
        words = []
        for _ in range(60):
            w = rng.choice(stems[:6] if rng.random() < 0.6 else stems)
            if rng.random() < 0.1:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + "z" + w[k + 1:], w[:k] + "z" + w[k:]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, " ".join(words) + rng.choice(["", "1,2", "Ā̀"])))
    rows += [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "x" * 9 + " abcdef")] * 6 + [(7, rows[7][1])]
    return rows + [(20_000 + i, "y" * 5_000 + " " + "y" * 5_001) for i in range(6)]


@pytest.mark.parametrize("block", [spelling_variants.BLOCK, 5])
def test_variants_equal_brute_force(spark, block):
    rows = spelling_rows()
    got = spelling_variants.variants(frame(spark, rows), block=block).collect()
    want = brute_variants(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert sum(r.form is not None for r in got) > 10 and max(r.n_near for r in got) > 3
    assert any(r.root != r.form for r in got if r.form is not None) or block == 5


def test_variants_of_nothing(spark):
    for rows in ([], [(1, None), (2, ""), (3, "only short words here")]):
        assert spelling_variants.variants(frame(spark, rows)).count() == 0


def test_no_near_pair_is_outside_the_steps_of_its_cell():
    rng = random.Random(1)
    cell = lambda w: (len(w), *(sum(c in x for c in w) for x in spelling_variants.CLASSES))
    steps = {s for s in spelling_variants.STEPS} | {tuple(-x for x in s) for s in spelling_variants.STEPS}
    for _ in range(3_000):
        w = [rng.choice("abcdelrstnéö") for _ in range(8)]
        v, k = list(w), rng.randrange(8)
        v[k:k + 1] = rng.choice([[], ["q"], ["a"], ["n"], [w[k], "s"]])
        assert tuple(y - x for x, y in zip(cell(w), cell(v))) in steps


def test_every_meeting_of_blocks_is_made_once(spark):
    words = ["".join(random.Random(i).choice("abn") for _ in range(6 + i % 3)) for i in range(300)]
    frame_ = spark.createDataFrame([(w, 5) for w in sorted(set(words))], "word string, n bigint")
    rows = spelling_variants.block_rows(frame_, 4).collect()
    sides = {}
    for r in rows:
        sides.setdefault(r.pair, ([], []))[r.side].append(r.word)
    seen = Counter(tuple(sorted((a, b))) for x, y in sides.values() for a in x for b in y if a != b)
    near = [(a, b) for a in set(words) for b in set(words) if a < b and is_near(a, b)]
    assert near and all(seen[p] for p in near)
    found = spelling_variants.near_words(frame_, 4).collect()
    assert Counter(tuple(sorted(r)) for r in found) == Counter(near)


def test_a_block_meets_itself_whatever_the_order_of_its_rows():
    words = ["".join(w) for w in product("abn", repeat=6)][:300]
    other = random.Random(3).sample(words, len(words))
    pair = {"len": 6, "c0": 1, "c1": 1, "step": 0, "k": 0, "j": 0}
    rows = pa.record_batch([pa.array([pair] * 600), pa.array([0] * 300 + [1] * 300), pa.array(words + other)],
                           names=["pair", "side", "word"])
    found = Counter(tuple(sorted(r.values())) for b in spelling_variants._meet(iter([rows])) for r in b.to_pylist())
    assert found == Counter((a, b) for a in words for b in words if a < b and is_near(a, b))


# ---- op12 ----

@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-2**63, 2**63 - 1), max_size=400, unique=True), st.integers(0, 399))
def test_filter_never_forgets_a_live_key(keys, cut):
    f = CuckooFilter(buckets=2)
    for k in keys:
        f.add(k)
    assert all(k in f for k in keys) and list(f.keys) == keys
    f.remove(keys[:cut])
    assert all(k in f for k in keys[cut:]) and list(f.keys) == keys[cut:]
    again = CuckooFilter(f.buckets, f.slots.tobytes(), f.keys.tobytes())
    assert all(k in again for k in keys[cut:])


def test_filter_resizes_and_lets_few_strangers_in():
    rng = random.Random(2)
    keys = [rng.getrandbits(64) - 2**63 for _ in range(20_000)]
    f = CuckooFilter(buckets=4)
    for k in keys:
        f.add(k)
    assert f.buckets * cuckoo_dedup.SLOTS >= len(keys) and all(k in f for k in keys)
    assert sum(rng.getrandbits(64) - 2**63 in f for _ in range(20_000)) < 20


def brute_normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def copies():
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["sun", "rain", "é", "moon"]) for _ in range(rng.choice([1, 2, 3, 30]))) for _ in range(80)]
    rows = [(i, rng.choice(texts).replace(" ", rng.choice([" ", "  ", "\n", "\t "]))) for i in range(400)]
    rows += [(1_000 + i, t) for i, t in enumerate([*ODD, *ODD])] + [(None, "moon"), (None, "only null"), (None, "only  null"), (5, rows[5][1])]
    rng.shuffle(rows)
    return rows


def brute_duplicates(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(brute_normal(t), []).append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return Counter((i, keep[x], len(groups[x]), i == keep[x], hashlib.sha256(x.encode()).hexdigest())
                   for i, x in ((i, brute_normal(t)) for i, t in rows))


def test_duplicates_equal_brute_force(spark):
    rows = copies()
    got = cuckoo_dedup.duplicates(frame(spark, rows).repartition(7)).collect()
    assert Counter(tuple(r) for r in got) == brute_duplicates(rows)
    kept = cuckoo_dedup.without_copies(frame(spark, rows))
    assert len(kept.columns) == 10
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert Counter(ids) == Counter(r[0] for r in got if r[3] and r[0] is not None)
    assert cuckoo_dedup.duplicates(frame(spark, [])).count() == 0


def test_normal_form_equals_the_expression():
    for t in [*ODD, "\x0b\x0ca\r\n\tb ", " ", "a  b"]:
        assert cuckoo_dedup.normalized((t or "").encode()).decode() == brute_normal(t)


@pytest.mark.parametrize("false_hits", [False, True])
def test_index_of_several_batches_with_deletion(spark, monkeypatch, false_hits):
    rows = [r for r in copies() if r[0] is not None]
    parts = [rows[0::3], rows[1::3], rows[2::3]]
    if false_hits:  # fingerprints that are all alike: every key is a hit, and only the content tells
        monkeypatch.setattr(cuckoo_dedup, "_arrive", _alike(cuckoo_dedup._arrive))
    index = CuckooIndex.empty(spark).insert(frame(spark, parts[0])).insert(frame(spark, parts[1]))
    gone = [t for _, t in parts[0][:40]] + ["not there"]
    index = index.delete(frame(spark, [(0, t) for t in gone]))
    out = {brute_normal(t) for t in gone}
    left = [(i, t) for i, t in parts[0] + parts[1] if brute_normal(t) not in out]
    live = lambda x: {(bytes(r.sha).hex(), r.keep_id, r.group_size) for r in x.groups().collect()}
    want = lambda r: {(s, k, n) for _, k, n, _, s in brute_duplicates(r)}
    assert live(index) == want(left)
    assert {bytes(r.sha).hex() for r in index.contains(frame(spark, rows)).collect()} == {
        hashlib.sha256(brute_normal(t).encode()).hexdigest() for _, t in left} & {
        hashlib.sha256(brute_normal(t).encode()).hexdigest() for _, t in rows}
    more = index.insert(frame(spark, parts[2]))  # with texts that were deleted, and come back
    assert live(more) == want(left + parts[2])
    larger = more.grown(shard_keys=4)
    assert larger.shards > more.shards and live(larger) == want(left + parts[2])
    assert live(larger.insert(frame(spark, parts[2]))) == want(left + parts[2] + parts[2])
    keys = sum(len(r["keys"]) // 8 for r in larger.filters.collect())
    assert keys == len(want(left + parts[2])) == larger.content.count()


def _alike(arrive):
    import pyarrow as pa

    def run(batches):
        for b in arrive(batches):
            keys = [(k >> 3 << 3) & ~0xFFFFFFFF | 7 for k in b.column("key").to_pylist()]
            yield pa.record_batch([pa.array(keys, pa.int64()), *b.columns[1:]], names=b.schema.names)
    return run


# ---- op13 ----

def brute_alignment(rows):
    tok = token_alignment.load(token_alignment.path_of(token_alignment.TOKENIZER_A), token_alignment.path_of(token_alignment.TOKENIZER_B))
    docs = []
    for doc_id, text in rows:
        a = tok.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tok.b.encode(text) if text else []
        pa_, pb = [tok.bytes_a[i] for i in a], [tok.bytes_b[i] for i in b]
        if not text or not b"".join(pa_) == b"".join(pb) == (" " + text).encode():
            docs.append((doc_id, [], [], [], []))
            continue
        ea, eb = np.cumsum([len(x) for x in pa_]), np.cumsum([len(x) for x in pb])
        cuts = sorted(set(ea.tolist()) & set(eb.tolist()))
        groups, links = [], []
        for lo, hi in zip([0, *cuts], cuts):
            ga = [k for k in range(len(a)) if lo < ea[k] <= hi]
            gb = [k for k in range(len(b)) if lo < eb[k] <= hi]
            groups.append(",".join(str(a[k]) for k in ga) + "|" + ",".join(str(b[k]) for k in gb))
            links += [(a[i], b[j]) for i in ga for j in gb if max(ea[i] - len(pa_[i]), eb[j] - len(pb[j])) < min(ea[i], eb[j])]
        docs.append((doc_id, a, b, groups, links))
    counts = Counter(x for d in docs for x in d[4])
    most = {}
    for (_, y), c in counts.items():
        most[y] = max(most.get(y, 0), c)
    return Counter((i, len(a), len(b), len(g), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for i, a, b, g, x in docs)


@pytest.mark.parametrize("head", [token_alignment.HEAD, 3, 0])
def test_alignment_equals_brute_force(spark, head):
    rng = random.Random(6)
    words = "the Theory été naïve <|endoftext|> <s> </s> don't we'll 3.14159 \t x\ty \n\n line\n  two  blanks éà😀 日本 --- ....... a▁b \x00 \x1c".split(" ")
    rows = [(i, " ".join(rng.choice(words[:-3] if i % 9 else words) for _ in range(25))) for i in range(60)]
    rows += [(100 + i, t[:3_000] if t else t) for i, t in enumerate(ODD)] + [(4, "the end"), (4, "the end"), (None, "two words"), (300, "▁")]
    got = token_alignment.align(frame(spark, rows), head=head).collect()
    assert Counter(tuple(r) for r in got) == brute_alignment(rows)
    assert sum(r.n_a == 0 for r in got) >= 4 and sum(r.n_a > 0 for r in got) > 60
    assert token_alignment.align(frame(spark, [])).count() == 0


@given(st.lists(st.integers(1, 60), min_size=1, max_size=40, unique=True), st.lists(st.integers(1, 60), min_size=1, max_size=40, unique=True))
def test_groups_lie_between_shared_cuts(a, b):
    a, b = sorted({*a, 61}), sorted({*b, 61})
    cuts = sorted(set(a) & set(b))
    found = token_alignment.groups(a, b)
    assert [a[g[1] - 1] for g in found] == cuts == [b[g[3] - 1] for g in found]
    assert [g[0] for g in found] == [0, *[g[1] for g in found[:-1]]] and [g[2] for g in found] == [0, *[g[3] for g in found[:-1]]]
    start = lambda x, k: x[k - 1] if k else 0
    links = [p for g in found for p in token_alignment.overlaps(a, b, g)]
    assert sorted(links) == [(i, j) for i in range(len(a)) for j in range(len(b)) if max(start(a, i), start(b, j)) < min(a[i], b[j])]
