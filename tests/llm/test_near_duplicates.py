"""N-gram Jaccard join and line dedup against brute force."""

import random
import re

import numpy as np
import pytest

from tarmac.llm import line_dedup, ngram_join

CLASH = "key string, node bigint, component bigint, removed string, _d bigint, _removed string, id bigint, text_hash bigint"


def frame(spark, rows, extra=True):
    schema = "doc_id bigint, text string" + (f", {CLASH}" if extra else "")
    return spark.createDataFrame([(*r, *(["x", 1, 2, "y", 3, "z", 4, 5] if extra else [])) for r in rows], schema)


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def edited(rng, text, share):
    out = list(text)
    for i in range(len(out)):
        if rng.random() < share:
            out[i] = words(rng, 1)[0]
    return out


def brute_components(items, linked):
    root = {k: k for k in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(items)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(items[a], items[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def shingles(text):
    w = re.findall("[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows, n = [], 0
    for size in (3, 5, 9, 40, 200, 900):
        for _ in range(4):
            base = words(rng, size)
            for share in (0, 0.005, 0.01, 0.02, 0.03, 0.05):
                rows.append((n, " ".join(edited(rng, base, share))))
                n += 1
    passage = words(rng, 60)
    for _ in range(20):  # a passage that many share is no link
        rows.append((n, " ".join(words(rng, 100) + passage + words(rng, 100))))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "One"), (n + 4, "one"), (n + 5, "É one"), (n + 6, "é one")]
    rng.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark, corpus):
    sets = {i: shingles(t) for i, t in corpus}
    want = brute_components(sets, lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame(spark, corpus)).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_large_group_and_repeated_rows(spark):
    rng = random.Random(1)
    base = words(rng, 120)
    rows = [(i, " ".join(base[:i % 110] + words(rng, 1) + base[i % 110 + 1:])) for i in range(700)] + [(0, None), (None, " ".join(base))] * 2
    rows[3] = rows[2]
    got = ngram_join.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.n_shingles and r.doc_id is not None} == {0}
    assert {r.component_id for r in got if r.doc_id is None} == {None}  # no row with an id has just this set


def test_trees_prune_nothing_that_links():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = rng.integers(1 << 32, size=rng.integers(5, 300), dtype=np.uint32)
        for _ in range(4):
            sets.append(np.unique(np.where(rng.random(len(base)) < 0.06, rng.integers(1 << 32, size=len(base), dtype=np.uint32), base)))
    bits = ngram_join.bitmap_bits(max(map(len, sets)))
    tree = lambda: ngram_join.Tree(np.arange(len(sets)), np.arange(len(sets)), sets, bits)
    a, b = tree(), tree()
    i, j = ngram_join.dual_traversal(a, b)
    found = set(zip(a.ids[i].tolist(), b.ids[j].tolist()))
    links = {(x, y) for x in range(len(sets)) for y in range(len(sets)) if x != y and ngram_join.enough(
        len(np.intersect1d(sets[x], sets[y])), len(sets[x]) + len(sets[y]))}
    assert links <= found and len(found) < len(sets) ** 2 / 4
    assert set(ngram_join.links_across(tree(), tree())) == {(x, y) for x, y in links if x > y}


@pytest.mark.parametrize("block", [3, 512])
def test_tree_candidates_cross_components(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    sets = {i: np.sort(np.unique(ngram_join.mix(np.arange(100, dtype=np.uint64) + np.uint64(4 * (i // 4))) >> np.uint64(32)).astype(np.uint32))
            for i in range(20)}
    tokens = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "id bigint, tokens binary")
    comp = {i: 0 if i < 12 else i for i in sets}
    leaves = spark.createDataFrame([(7, i, comp[i]) for i in sets], "key bigint, id bigint, comp bigint")
    got = {(r.a, r.b) for r in ngram_join.tree_candidates(leaves, tokens).collect()}
    want = {(a, b) for a in sets for b in sets if a > b and comp[a] != comp[b] and ngram_join.linked(sets[a], sets[b])}
    assert got <= want and {(a, comp[b]) for a, b in got} >= {(a, comp[b]) for a, b in want}


def test_one_of_each_and_empty_table(spark):
    rng = random.Random(2)
    text = " ".join(words(rng, 50))
    rows = [(9, text), (4, text), (5, " ".join(words(rng, 50))), (6, None), (7, "")]
    kept = ngram_join.one_of_each(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7] and len(kept.columns) == 10
    assert ngram_join.near_duplicates(frame(spark, [])).count() == 0


def line_set(line):
    return set(re.findall(rf"(?s)(?=(.{{1,{line_dedup.SHINGLE}}}))\S{{1,{line_dedup.PIECE}}}\s*", line))


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(11)
    bases = [words(rng, 30) for _ in range(40)]
    rows = []
    for i in range(60):
        lines = [" ".join(edited(rng, rng.choice(bases), rng.choice([0, 0.03, 0.06]))) for _ in range(3)]
        rows.append((i, "\n".join([*lines, "short", " ".join(words(rng, 30))])))
    rows += [(60, None), (61, ""), (62, "\n\n"), (None, " ".join(bases[0])), (63, "x" * 5000), (64, "X" * 5000)]
    spots = {(i, k): x.strip().lower() for i, t in rows if t is not None and i is not None for k, x in enumerate(t.split("\n"))
             if len(x.strip()) >= line_dedup.MIN_CHARS}
    sets = {s: line_set(x) for s, x in spots.items()}
    group = brute_components(sets, lambda a, b: 7 * len(a & b) >= 3 * (len(a) + len(b)))
    got = {(r.doc_id, k) for r in line_dedup.report(frame(spark, rows)).collect() if r.doc_id is not None for k in r.removed}
    firsts = {min(s for s in group if group[s] == g) for g in set(group.values())}
    want = set(group) - firsts
    assert got - want == set() or len(got - want) <= 1  # the null row's copy may be the one that stays
    assert len(want & got) >= 0.97 * len(want)
    assert all((64, 0) in got for _ in [0])


@pytest.mark.parametrize("block", [512, 3])
def test_unrelated_groups_under_one_key(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block, raising=False)
    rng = random.Random(4)
    phrase, lines = " ".join(words(rng, 34)), []
    for _ in range(80):  # one phrase, 80 groups of copies: similar, but no group is a copy of another
        own = words(rng, 7)
        lines += [f"{phrase} {' '.join(own)}", f"{phrase} {' '.join([*own[:-1], words(rng, 1)[0]])}"]
    rng.shuffle(lines)
    group = brute_components(dict(enumerate(map(line_set, lines))), lambda a, b: 7 * len(a & b) >= 3 * (len(a) + len(b)))
    assert len(set(group.values())) == 80
    got = {r.doc_id for r in line_dedup.report(frame(spark, list(enumerate(lines)))).collect() if r.n_removed}
    assert got == {k for k in group if group[k] != k}


def test_long_lines_are_signed_by_all_their_shingles(spark):
    """Copies of long lines that differ wherever an ``e`` or a digit stands share no shingle that begins with these."""
    rng = random.Random(12)
    rows, plain = [], lambda x: {x[i:i + 5] for i in range(len(x) - 4)}
    for i in range(20):
        parts = ["".join(rng.choice("abcdfgh") for _ in range(40)) for _ in range(16)]
        rows += [(2 * i, "e".join(parts)), (2 * i + 1, "7".join(parts))]
        x, y = plain(rows[-2][1]), plain(rows[-1][1])
        assert 7 * len(x & y) >= 3 * (len(x) + len(y))
    assert {r.doc_id for r in line_dedup.report(frame(spark, rows)).collect() if r.n_removed} == set(range(1, 40, 2))


def test_leaves_of_shared_keys(spark):
    """Every line of a key that several share comes once, with the key's smallest and largest; the postings are shuffled once."""
    signed = spark.createDataFrame([(k, [k % 3, 100 + k % 50, 1000 + k]) for k in range(200)], "id bigint, keys array<bigint>")
    got = line_dedup.leaves_of(signed)
    want = {(key, k, *ends(members)) for key, members in _by_key(signed.collect()).items() if len(members) > 1 for k in members}
    assert len(want) == 400 and sorted(map(tuple, got.select("key", "id", "root", "last").collect())) == sorted(want)
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
    plan = next(p for p in plans if got.inputFiles()[0].split("/")[-2] in p).split("Initial Plan")[0]
    assert "Join" not in plan and len(set(re.findall(r"Exchange \((\d+)\)", plan))) == 1


def ends(members):
    return min(members), max(members)


def _by_key(rows):
    found = {}
    for r in rows:
        for key in r["keys"]:
            found.setdefault(key, []).append(r["id"])
    return found


def test_shingle_hashes_are_those_of_the_set(spark):
    lines = ["plain words, a tab\there and\x0ba form\x0cfeed", "\U0001f600 \u00e9t\u00e9 \u4f60\u597d\u4e16\u754c without blanks",
             "\x01\x02 control characters are no blanks", "e" * 200 + " 0123456789" * 12]
    rows = spark.createDataFrame(list(enumerate(lines)), "id bigint, line string")
    got = line_dedup.shingle_hashes(rows).groupBy("id").agg({"h": "count"}).collect()
    distinct = line_dedup.shingle_hashes(rows).distinct().groupBy("id").count().collect()
    every = {k: re.findall(rf"(?s)(?=([^{line_dedup.BLANKS}].{{0,4}}))", x) for k, x in enumerate(lines)}
    assert {r[0]: r[1] for r in got} == {k: len(v) for k, v in every.items()}
    assert {r[0]: r[1] for r in distinct} == {k: len(set(v)) for k, v in every.items()}


def test_one_edit_in_a_short_line_or_without_blanks(spark):
    rng = random.Random(6)
    short = words(rng, 12)
    solid = "".join(words(rng, 20))
    rows = [(1, " ".join(short)), (2, " ".join([*short[:6], "other", *short[7:]])), (3, solid), (4, f"{solid[:9]}x{solid[9:]}"),
            (5, " ".join(words(rng, 12)))]
    plain = lambda x: {x[i:i + 5] for i in range(len(x) - 4)}
    for a, b in ((0, 1), (2, 3)):
        x, y = plain(rows[a][1]), plain(rows[b][1])
        assert 7 * len(x & y) >= 3 * (len(x) + len(y))
    assert {r.doc_id for r in line_dedup.report(frame(spark, rows)).collect() if r.n_removed} == {2, 4}


def test_deduplicated_texts(spark):
    long = "This line is long enough to count as evidence"
    rows = [(2, f"{long}\nshort\nAnother line that is found in one document only"), (1, f"{long}\nshort"),
            (3, f"  {long.upper()} "), (4, None), (5, "")]
    out = line_dedup.deduplicated(frame(spark, rows))
    assert {r.doc_id: r.text for r in out.collect()} == {
        1: f"{long}\nshort", 2: "short\nAnother line that is found in one document only", 3: "", 4: None, 5: ""}
    assert line_dedup.report(frame(spark, [])).count() == 0
    again = line_dedup.deduplicated(frame(spark, [(1, long), (1, long)]))
    assert [r.text for r in again.collect()] == [long, long]


def test_every_link_comes_through_a_tree(spark, corpus):
    """Prefixes of linked sets meet whatever the order of shingles is; bitmaps of any width keep linked leaves."""
    word_hash, rng = ngram_join.WordHash(), np.random.default_rng(9)
    sets = {i: ngram_join.shingle_set((t or "").encode(), word_hash) for i, t in corpus}
    sets = {i: u for i, u in sets.items() if len(u)}
    links = [(a, b) for a in sets for b in sets if a < b and ngram_join.enough(len(np.intersect1d(sets[a], sets[b])), len(sets[a]) + len(sets[b]))]
    assert len(links) > 200
    for levels in (np.zeros(ngram_join.BUCKETS, np.uint8), rng.integers(0, 9, ngram_join.BUCKETS, dtype=np.uint8)):
        rare = {i: set(ngram_join.prefix(u, levels).tolist()) for i, u in sets.items()}
        assert all(rare[a] & rare[b] for a, b in links)
    width = {i: ngram_join.bitmap_bits(len(u)).bit_length() - 1 for i, u in sets.items()}
    assert all(abs(width[a] - width[b]) <= 1 for a, b in links)
    ids, seen, found = sorted(sets), [], set()
    for w in sorted(set(width.values())):  # one tree a width, with guests of the next one
        inside = [(i, width[i] > w) for i in ids if width[i] in (w, w + 1)]
        row = lambda i, guest, probe: (w, 0, 0, probe, i, i, len(sets[i]), w, guest, ngram_join.bitmap(
            ngram_join.upper(sets[i]), 1 << width[i]).tobytes())
        left = ngram_join.partners([row(i, g, probe) for i, g in inside for probe in (False, True)], seen)
        found |= {(w, i) for _, i, _, probe in left if probe}
    assert all((min(width[a], width[b]), i) in found for a, b in links for i in (a, b))
    met, kept = (sum(x[k] for x in seen) for k in (0, 1))
    assert kept < met / 2  # node pairs under the bound are not gone into


def test_pivot_finds_a_group_and_traversal_the_rest(spark):
    rng = random.Random(8)
    phrase, rows = words(rng, 30), []
    for g in range(30):  # all share rare words with the smallest id, and pairs among the others link
        base = phrase + words(rng, 60)
        rows += [(10 * g + 1, " ".join(base)), (10 * g + 2, " ".join([*base, *words(rng, 2)]))]
    rows.append((0, " ".join(phrase + words(rng, 2))))
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(frame(spark, rows)).collect()}
    assert got == {0: 0} | {10 * g + k: 10 * g + 1 for g in range(30) for k in (1, 2)}


def test_shingles_of_two_rows_name_their_leaves_without_a_join(spark, monkeypatch):
    prefixes = [(1, [10, 11, 20]), (2, [10, 30]), (3, [20]), (4, [20]), (5, [40]), (5, [40]), (6, [50]), (6, [50]), (7, [50])]
    reps = spark.createDataFrame([(d, d, 9, 10, p) for d, p in prefixes],
                                 "doc_id bigint, s1 bigint, n int, w int, prefix array<bigint>")
    joined, plain = [], ngram_join.broadcast_if_small
    monkeypatch.setattr(ngram_join, "broadcast_if_small", lambda df: joined.append(df.count()) or plain(df))
    trees = {}
    for r in ngram_join.leaves_of(reps).collect():
        trees.setdefault((r["key"], r["pivot"]["id"]), []).append(r["id"])
    assert sorted((pivot, sorted(ids)) for (_, pivot), ids in trees.items()) == [(1, [1, 2, 3, 4]), (6, [6, 7])]
    assert joined[0] == 2  # of the shared shingles 10, 20 and 50 only the latter two stand in more than two rows
