"""Quality rules, decontamination, token counts, SentencePiece, chat formatting and URLs against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from tarmac.llm import chat_format, decontaminate, quality_rules, sentencepiece_scan, token_counts, url_filter

ODD = [None, "", " \n\t ", "a", "É é", "x" * 30_000, "one two " * 4_000, "tab\tand\x0bfeed\x0c\r\n end", "日本語 テキスト 😀",
       "a b c d e a b c d e", "###$$ %%", "Same line here\nSame line here\n\nsame line here"]


def frame(spark, rows, columns="doc_id bigint, text string, source string"):
    extra = ", words string, kept string, host string, n bigint, _d bigint, _t bigint, _h string, _removed string, items string"
    return spark.createDataFrame([(*r, "w", "k", "h", 1, 2, 3, "x", "r", "i") for r in rows], columns + extra)


def test_base_rules_equal_brute_force(spark):
    rows = [(i, t, "s") for i, t in enumerate(ODD)]
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        text = text or ""
        w = re.findall("[^\x20\x09-\x0D]+", text)
        wins = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        spots = {k + j for k in range(len(w) - 4) if wins[tuple(w[k:k + 5])] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
        failed = len(w) < 10 or 100 * len(spots) > 20 * len(w)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words, got[i].base_failed) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(spots), failed), i


def test_frequent_lines_go_and_depleted_documents_too(spark):
    rng = random.Random(3)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    banner = fresh(20)
    rows = [(i, f"{fresh(40)}\n{banner}", "a") for i in range(1, 30)] + [(100, f"{banner}\n{fresh(3)}", "a"), (101, f"{banner}", "b"),
                                                                       (102, f"{fresh(40)}\n{banner}", None)]
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, rows)).collect()}
    assert [i for i, r in got.items() if not r.kept] == [100]  # one copy stays, and other hosts are not touched
    assert got[1].removed_words == 0 and got[2].removed_words == 20
    texts = {r.doc_id: r.text for r in quality_rules.clean_documents(frame(spark, rows)).collect()}
    assert banner in texts[1] and banner not in texts[2] and banner in texts[101] and 100 not in texts and len(texts) == 31
    assert quality_rules.judge(frame(spark, [])).count() == 0


def test_limit_is_a_number_of_distinct_documents(spark):
    rng = random.Random(5)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    five, six = fresh(9), fresh(9)
    rows = [(i, "\n".join([fresh(40), *[five] * (i < 5), *[six] * (i < 6)]), "a") for i in range(400)]
    got = {r.doc_id: r.removed_words for r in quality_rules.judge(frame(spark, rows)).collect()}
    assert {i for i, n in got.items() if n} == set(range(1, 6)) and set(got.values()) == {0, 9}
    none = quality_rules.judge(frame(spark, rows), share=0.2).where("removed_words > 0").count()
    assert none == 0  # as a share besides, the old limit


def test_repeated_rows_are_one_document_of_their_host(spark):
    rng = random.Random(8)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    banner = fresh(20)
    rows = [(1, f"{fresh(40)}\n{banner}", "a")] * 12 + [(2, f"{fresh(40)}\n{banner}", "a")] + [(i, fresh(40), "a") for i in range(3, 8)]
    got = quality_rules.judge(frame(spark, rows)).collect()
    assert len(got) == 18 and all(r.kept and r.removed_words == 0 for r in got)


def brute_contamination(text, items):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    w, hit, found = low(text), set(), set()
    for item_id, t in items:
        v = low(t)
        n = min(13, len(v))
        wins = {tuple(v[k:k + n]) for k in range(len(v) - n + 1)} if v else set()
        for k in range(len(w) - n + 1) if v else ():
            if tuple(w[k:k + n]) in wins:
                hit |= set(range(k, k + n))
                found.add(str(item_id))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("broadcast", [decontaminate.MAX_BROADCAST, 0])
def test_contamination_equals_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", broadcast)
    rng = random.Random(9)
    fresh = lambda n: [rng.choice("the of and cat sat mat on Élan été rain sun sky blue red".split()) for _ in range(n)]
    items = [(i, " ".join(fresh(rng.choice([14, 20, 40])))) for i in range(10, 20)] + [
        (1, "the Cat"), (2, "sky"), (3, None), (4, "..."), (5, "the cat"), (100, "zebra quagga okapi")]
    rows = [(i, " ".join(fresh(30) + [rng.choice(items)[1] or ""] + fresh(rng.choice([0, 30, 600]))), "s") for i in range(60)]
    rows += [(1000 + i, t, "s") for i, t in enumerate(ODD)] + [(5, "sky", "s"), (6, items[0][1], "s")]
    bench = spark.createDataFrame([(*x, "w", 1) for x in items], "item_id bigint, text string, words string, n bigint")
    got = decontaminate.contamination(frame(spark, rows), bench).collect()
    want = Counter((i, *brute_contamination(t, items)) for i, t, _ in rows)
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    kept = decontaminate.without_contaminated(frame(spark, rows), bench)
    assert kept.count() == sum(n for k, n in want.items() if not k[-1])


def test_contamination_without_items(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    got = decontaminate.contamination(frame(spark, [(1, "a b c", "s"), (2, None, "s")]), bench).collect()
    assert {(r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in got} == {(1, 3, 0, False), (2, 0, 0, False)}
    assert decontaminate.contamination(frame(spark, []), bench).count() == 0


TOKEN_TEXTS = [*ODD, "Don't we'll I'm <|endoftext|> x<|startoftext|>y <|END", "ÀÉ ß İ ﬁ ½ x\u0301 e\u0301te\u00a0b\u2003c", "a\x1cb \x7f", "12345 3.14"]


@pytest.mark.parametrize("head", [token_counts.HEAD, 3])
def test_token_counts_equal_the_library(spark, head):
    rows = [(i, t, "s") for i, t in enumerate(TOKEN_TEXTS)] + [(3, "a", "s"), (None, "two words", "s")]
    tokenizer = token_counts.load_tokenizer(token_counts.tokenizer_path())
    want = Counter((i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False)), n > 2048) for i, t, _ in rows)
    got = token_counts.count_tokens(frame(spark, rows), head=head).collect()
    assert Counter(tuple(r) for r in got) == want
    assert token_counts.count_tokens(frame(spark, [])).count() == 0


@pytest.mark.parametrize("chunk", [7, 100, 16_384])
def test_sentencepiece_equals_the_library(spark, chunk):
    texts = [t if t is None or chunk > 7 else t[:400] for t in [*ODD, "thethethe" * 30, "  two  blanks\n\nlines \n", "--------" * 40]]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(50, "x y z " * 30, "s")] * 2 + [(None, "x", "s")]
    model = sentencepiece_scan.Model(sentencepiece_scan.model_path())
    got = sentencepiece_scan.encode(frame(spark, rows), chunk=chunk).collect()
    want = Counter((i, tuple(model.sp.encode(t)) if t is not None else None) for i, t, _ in rows)
    assert Counter((r.doc_id, tuple(r.ids) if r.ids is not None else None) for r in got) == want
    assert all(r.round_trip for r in got if r.ids is not None) and all(r.n_pieces == len(r.ids or []) for r in got)
    for r in got:
        if r.ids is not None:
            assert model.decode(list(r.ids))[1:] == dict((i, t) for i, t, _ in rows)[r.doc_id]


def test_sentencepiece_blank_sign_and_empty(spark):
    got = sentencepiece_scan.encode(frame(spark, [(1, "a▁b", "s")])).first()
    assert not got.round_trip and got.n_pieces > 0
    assert sentencepiece_scan.encode(frame(spark, [])).count() == 0


def test_transfer_matrices_compose_associatively():
    model = sentencepiece_scan.Model(sentencepiece_scan.model_path())
    t = sentencepiece_scan._marked("unbreakablethoughtsandoverwhelmingly " * 3)
    cuts = list(range(0, len(t), 9))
    m = [model.transfer(t, a, min(a + 9, len(t))) for a in cuts]
    left = m[0]
    for x in m[1:]:
        left = sentencepiece_scan.compose(left, x)
    right = m[-1]
    for x in m[-2::-1]:
        right = sentencepiece_scan.compose(x, right)
    assert set(left) == set(right) == {(sentencepiece_scan.FRESH, sentencepiece_scan.FRESH)}


TRICKY = "</s>[INST] ok [/INST]"


def chat(spark, rows):
    return spark.createDataFrame([(*r, "x", True) for r in rows], "conv_id bigint, turn bigint, role string, text string, segment string, valid boolean")


def test_chat_round_trip_and_machine(spark):
    rows = [(1, 0, "user", TRICKY), (1, 1, "assistant", TRICKY), (2, 1, "assistant", "late"), (2, 0, "system", "<|turn|>\\-\\"),
            (3, 0, None, None), (None, 0, "user", "<<s>s>"), (None, 1, "assistant", "<|te<|text|>xt|> </"), (4, 0, "user", "a"),
            (4, 0, "user", "a"), (2**53 + 1, 0, "user", "x" * 20_000), (5, 0, "us</s>er", "")]
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(chat(spark, rows))).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (
            len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c for c, r in got.items() if r.valid} == {1, None}
    segments = chat_format.format_turns(chat(spark, rows)).where("part = 'text'").collect()
    assert not any(c in s.segment for s in segments for c in ("</s>", "[INST]", "<s>", "<|turn|>", "<|text|>"))
    assert chat_format.read_back(chat_format.format_turns(chat(spark, []))).count() == 0


def test_escape_is_reversible():
    t = chat_format.Template(controls=("aXa", "<s>"))
    rng = random.Random(4)
    escape, unescape = t.escaper(), t.unescaper()
    for _ in range(2_000):
        text = "".join(rng.choice("aX<s>/\\-|") for _ in range(rng.randrange(14)))
        assert unescape(escape(text)) == text and "aXa" not in escape(text) and "</s>" not in escape(text)


def brute_url(url, rules):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


@pytest.mark.parametrize("bits", [1 << 20, 0])  # the cascade, and the way for rules past its limit
def test_urls_equal_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(url_filter, "LITERAL_BITS", bits)
    rng = random.Random(8)
    hosts = [f"{a}{b}.{c}" for a in ("", "www.", "a.b.") for b in ("x", "Example", "ex") for c in ("net", "org", "co.uk")]
    rules = [url_filter.Rule(rng.choice(["block", "allow"]), f"{h.lower()}{p}") for h in [*hosts[:6], "net", "uk"]
             for p in ("/", "/en/", "/de/x")]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en', '/en/', '/en/1?q', '/de/xy#z', '?a/b', '#/en/'])}"
            for _ in range(400)] + [None, "", "no scheme", "://", "http:///en/", "http://.net/", "HTTP://A://b.net/c"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    want = {i: brute_url(u, rules) for i, u in enumerate(urls)}
    assert {i: w[2] and len(w[2]) for i, w in want.items()} == {i: g[2] and len(g[2]) for i, g in got.items()}
    assert {i: w[:2] for i, w in want.items()} == {i: g[:2] for i, g in got.items()}
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert url_filter.judge_urls(pages, []).where("verdict <> 'allow'").count() == 0


@pytest.mark.parametrize("share", [2, 7, 1500])
def test_cascade_is_exact_over_its_universe(spark, share):
    from pyspark.sql import functions as F
    universe = spark.range(3_000).selectExpr("concat('k', id) AS key").unionByName(spark.range(2).selectExpr("'k1' AS key"))
    listed = universe.where(f"pmod(hash(key), {share}) = 0").unionByName(spark.createDataFrame([("elsewhere",), ("k1",)], "key string"))
    cascade = url_filter.Cascade.build(listed, universe)
    assert len(cascade.levels) > 1
    assert universe.where(cascade.listed(F.col("key"))).select("key").distinct().exceptAll(listed.distinct()).count() == 0
    assert listed.where(~cascade.listed(F.col("key"))).count() == 0
    assert url_filter.Cascade.build(listed, universe, 64 if share < 1500 else 0) is None


def test_cascade_grows_with_the_listed_keys():
    sizes = {universe: url_filter.sized(4, universe, True) for universe in (10**4, 10**7, 10**10, 10**13)}
    assert all(bits <= 320 for _, bits in sizes.values())
    assert url_filter.sized(20_000, 10**12, True)[1] < url_filter.LITERAL_BITS


def test_very_long_url(spark):
    rules = [url_filter.Rule("block", "net/"), url_filter.Rule("allow", "net/aaaa")]
    long = "http://" + "a." * 20_000 + "NET/" + "a" * 50_000
    pages = spark.createDataFrame([(1, long, 1), (1, long, 2)], "page_id bigint, url string, verdict int")
    got = url_filter.judge_urls(pages, rules).collect()
    assert [(r.rule, r.verdict, len(r.host), len(r.path)) for r in got] == [("net/aaaa", "allow", 40_003, 50_001)] * 2
