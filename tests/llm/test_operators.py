"""Operators against brute force, exact round trips and held-out accuracy, with odd rows and empty tables."""

import hashlib
import itertools
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import duck, rows

from gapweave.llm import decontam, html_layout, near, ngram_lm, ogg, packed, packing, quality, queries, simhash, substring, textops, urlfilter, wavelet, wordbpe

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def collected(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, sf, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert rows(got) == rows(duck(queries.SQL[name], sf))


def test_every_query_runs_on_its_whole_table(spark, sf):
    n = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("documents", "pages")}
    for name, q in queries.QUERIES.items():
        out = q(spark, sf)
        if name.split("_")[0] in ("op1", "op2", "op4", "op5", "op6", "op10"):
            assert out.count() == n["documents"], name
        elif name.split("_")[0] in ("op3", "op7"):
            assert out.count() == n["pages"], name


# 1
def test_quality(spark, sf, odd, empty):
    out = queries.op1_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(out) > 50 and (out.predicted == out.quality).mean() > 0.95
    labels = spark.createDataFrame([(i, int(i != 9 and i != 10)) for i in range(1, 12)] + [(None, 1), (1, None)], "doc_id long, quality int")
    model = quality.fit(odd, labels, F.lit(True))
    got = collected(quality.score(odd, model))
    assert len(got) == odd.count() and all(0 <= s <= 1 and p == (s >= 0.7) for _, s, p in got)
    one = quality.fit(odd, labels.where("quality = 1"), F.lit(True))
    assert {s for _, s, _ in collected(quality.score(odd, one))} == {1.0}
    none = quality.fit(empty, labels.limit(0), F.lit(True))
    assert collected(quality.score(empty, none)) == [] and quality.keep_good(odd, one).columns == odd.columns


# 2
def test_ogg(spark, odd, empty):
    out = ogg.from_media(ogg.to_media(odd))
    got = {(r["doc_id"], r["payload_bytes"]): r for r in out.collect()}
    for r in odd.collect():
        n, raw = ogg.payload(r["text"])
        mine = got[(r["doc_id"], len(raw))]
        assert mine["n_bytes"] == n and bytes(mine["samples"]) == raw and mine["problem"] is None
    assert ogg.from_media(ogg.to_media(empty)).count() == 0
    for n in (0, 1, 254, 255, 256, 65025, 65026, 200_000):
        raw = random.Random(n).randbytes(n)
        for packet in (255, 510, 2304):
            assert ogg.decode(ogg.encode(raw, packet=packet)).samples == raw
    whole = bytearray(ogg.encode(b"abc" * 5000))
    for at in (3, 20, 60, len(whole) - 1):
        broken = bytearray(whole)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            ogg.decode(bytes(broken))
    with pytest.raises(ValueError):
        ogg.decode(bytes(whole[:-5]))
    assert ogg.from_media(spark.createDataFrame([(None,), (bytearray(b"x"),)], "media binary")).where("problem IS NULL").count() == 0


def test_ogg_against_a_plain_reader(spark, odd):
    """Pages, checksums bit by bit, packets, timestamps and digests, without the operator's tables."""

    def crc(raw):
        out = 0
        for byte in raw:
            out ^= byte << 24
            for _ in range(8):
                out = (out << 1 ^ 0x04C11DB7 if out >> 31 else out << 1) & 0xFFFFFFFF
        return out

    docs = odd.where("doc_id IN (1, 2, 3, 4, 6, 8)").distinct()
    media = {r["doc_id"]: bytes(r["media"]) for r in ogg.to_media(docs).collect()}
    got = {r["doc_id"]: r for r in ogg.from_media(ogg.to_media(docs)).collect()}
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        want = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        own, at, packets, granules = media[r["doc_id"]], 0, {}, {}
        while at < len(own):
            assert own[at : at + 4] == b"OggS"
            n, serial = own[at + 26], own[at + 14 : at + 18]
            lacing = own[at + 27 : at + 27 + n]
            end = at + 27 + n + sum(lacing)
            page = own[at:end]
            assert crc(page[:22] + bytes(4) + page[26:]) == int.from_bytes(page[22:26], "little")
            body = page[27 + n :]
            mine = packets.setdefault(serial, [b""])
            for size in lacing:
                mine[-1] += body[:size]
                body = body[size:]
                if size < 255:
                    mine.append(b"")
            # -1: no packet ends on the page.
            if (granule := int.from_bytes(page[6:14], "little", signed=True)) != -1:
                granules[serial] = granule
            at = end
        streams = [p[1:-1] for p in packets.values()]
        assert b"".join(x for pair in itertools.zip_longest(*streams, fillvalue=b"") for x in pair) == want == bytes(got[r["doc_id"]]["samples"])
        ends = [sum(map(len, s)) for s in streams]
        assert list(granules.values()) == ends and f"ends={ends[0] / 8000:.4f}/{ends[1] / 8000:.4f};" in got[r["doc_id"]]["feature"]


def test_ogg_query_digests(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op2_ogg(spark, sf).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        whole = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
        if r["doc_id"] % 20 == 0:
            media = ogg.encode(whole)
            assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())


# 3
def test_urls(spark, empty):
    urls = ["http://www.Example.com/en/x", "https://a.example.com/en/", "http://com", "http://com/", "http://xcom/", "http://a.net/fr/1?x", "http://b.net/FR/", None, "nope", "", "a://b://c.net/es/#f", "http://n.net/es/", "http://n.net/es/"]
    pages = spark.createDataFrame([(i, u, 5, "c") for i, u in enumerate(urls)], "page_id long, url string, _id int, host string")
    rules = [*queries.URL_RULES, urlfilter.Rule("example.org", "block"), urlfilter.Rule("net/e", "block")]
    want = []
    for i, u in enumerate(urls):
        host, path = urlfilter.parts(u)
        fits = []
        for r in rules:
            h, slash, p = r.text.partition("/")
            if (host == h or host.endswith("." + h)) and (not slash or path.startswith("/" + p)):
                fits.append(r)
        best = max(fits, key=lambda r: len(r.text), default=None)
        want.append((i, host, path, best and best.text, best.verdict if best else "allow"))
    assert sorted(collected(urlfilter.judge(pages, rules))) == want
    assert urlfilter.judge(pages.limit(0), rules).count() == 0 and urlfilter.judge(pages, []).where("rule IS NOT NULL").count() == 0


def test_urls_ties_go_to_the_first_rule_by_text(spark):
    pages = spark.createDataFrame([(1, "http://a.b.com/x/y")], "page_id long, url string")
    rules = [urlfilter.Rule("b.com/x/", "allow"), urlfilter.Rule("a.b.com/", "block")]
    assert len(rules[0].text) == len(rules[1].text)
    assert urlfilter.judge(pages, rules).first()["rule"] == urlfilter.judge(pages, rules[::-1]).first()["rule"] == "a.b.com/"


def test_word_hashes():
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("abñ漢", k=rng.randrange(1, 9))) for _ in range(20_000)} | {"x" * n for n in range(1, 200)} | {"", "ab", "ba"})
    for seed in (0, 1):
        h = textops.hashed(pa.array(words), seed)
        assert len(set(h.tolist())) == len(words) and (np.bincount((h >> np.uint64(60)).astype(int), minlength=16) > len(words) / 20).all()
        assert (textops.hashed(pa.array(["?", *words]).slice(1), seed) == h).all() and (textops.hashed(pa.array(words[::-1]), seed)[::-1] == h).all()
    assert not len(np.intersect1d(textops.hashed(pa.array(words[1:]), 0), textops.hashed(pa.array(words[1:]), 1))) and len(textops.hashed(pa.array([], pa.string()))) == 0


# 4
def test_language_model(spark, odd, empty):
    model = ngram_lm.train(odd)
    counts = Counter(w for r in odd.collect() for w in [*low(r["text"]), "\n"])
    n, v = sum(counts.values()), len(counts)
    assert (model.tokens, model.distinct) == (n, v)
    got = {(r["doc_id"], r["n_tokens"]): r for r in ngram_lm.score(odd, model, "doc_id").collect()}
    for r in odd.collect():
        words = [*low(r["text"]), "\n"]
        mine = got[(r["doc_id"], len(words))]
        assert mine["n_known"] == len(words) and mine["base_score"] == pytest.approx(sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words))
        assert mine["score"] < 0
    blank = ngram_lm.train(empty)
    assert blank.tokens == 0
    assert {r["n_known"] for r in ngram_lm.score(odd, blank, "doc_id").collect()} == {0}


def test_language_model_against_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(f"x{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(0, 40))) for _ in range(80)]
    texts += ["x0 x0 x0 x0 x1", "", "only once here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    model = ngram_lm.train(docs)
    assert model.spread.size
    threes = Counter()
    for t in texts:
        seq = ["<s>", "<s>", *t.split(), "</s>"]
        threes.update(zip(seq, seq[1:], seq[2:]))
    twos = Counter((b, c) for _, b, c in threes)
    twos |= Counter({(b, c): n for (_, b, c), n in threes.items() if b == "<s>"})
    ones = Counter(c for _, c in twos)
    words, types = set(ones), len(twos)

    def discounts(counts):
        n = [0, *(sum(c == k for c in counts) for k in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2])
        d = 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]
        return [float(np.clip(x, 0.05, k - 0.05)) for x, k in zip(d, (1, 2, 3))]

    d3, d2, d1 = ([0, *d] for d in model.discounts)
    assert (d3[1:], d2[1:]) == (pytest.approx(discounts(threes.values())), pytest.approx(discounts(twos.values()))) and model.types == types

    def one(c):
        return (max(ones[c] - d1[min(ones[c], 3)], 0) if c in ones else 0) / types + sum(d1[min(n, 3)] for n in ones.values()) / types / (len(words) + 1)

    def level(own, c, d, lower):
        total = sum(own.values())
        n = own.get(c, 0)
        return (max(n - d[min(n, 3)], 0) + sum(d[min(n, 3)] for n in own.values()) * lower) / total if total else lower

    def two(b, c):
        return level({y: n for (x, y), n in twos.items() if x == b}, c, d2, one(c))

    def three(a, b, c):
        return level({z: n for (x, y, z), n in threes.items() if (x, y) == (a, b)}, c, d3, two(b, c))

    for a, b in (("<s>", "<s>"), ("<s>", "x1"), ("x1", "x2"), ("x0", "x0"), ("x39", "x0"), ("unseen", "x1"), ("once", "here"), ("x1", "unseen")):
        assert sum(three(a, b, c) for c in [*words, "unseen"]) == pytest.approx(1)
    asked = ["x1 x2 x3", "unseen x1 unseen x1 x0", "", "x39 x0 x0 x0 x1", "only once here", "here once only", *texts[:10]]
    got = ngram_lm.score(spark.createDataFrame(list(enumerate(asked)), "doc_id int, text string"), model, "doc_id").orderBy("doc_id").collect()
    for t, r in zip(asked, got):
        seq = ["<s>", "<s>", *t.split(), "</s>"]
        assert r["score"] == pytest.approx(sum(np.log10(three(*x)) for x in zip(seq, seq[1:], seq[2:])))


def test_language_model_counts_beyond_32_bits(tmp_path):
    big = np.array([1, 1 << 33, 7, 1 << 33], np.uint64)
    keys, (total,) = ngram_lm._summed(np.array([5, 5, 9, 5], np.uint64), [big])
    assert keys.tolist() == [5, 9] and total.tolist() == [(1 << 34) + 1, 7]
    assert [x.tolist() for x in ngram_lm._joined([packed.encode([keys, ngram_lm._narrow(total)])])] == [[5, 9], [(1 << 34) + 1, 7]]
    arrays = ngram_lm.Arrays(str(tmp_path), 6, (1,))
    held = np.array([3, 1 << 39, (1 << 39) + 1, 4, 300], np.uint64)
    arrays.write(9, held, [np.array([1, 1 << 35, 255, 256, 1], np.uint64)])
    arrays.full.add(9)
    route = np.full(7, 9 << 58, np.uint64)
    found, (value,) = arrays.lookup(route, np.append(held, np.array([2, 301], np.uint64)))
    assert found.tolist() == [True] * 5 + [False] * 2 and value.tolist() == [1, 1 << 35, 255, 256, 1, 0, 0]
    assert not arrays.lookup(route ^ np.uint64(1 << 58), np.append(held, np.array([2, 301], np.uint64)))[0].any()


# 5
@pytest.mark.parametrize("width", [4, 40, 50])
def test_substring(spark, odd, empty, width):
    docs = odd.where("doc_id IS NOT NULL").select("doc_id", "text").distinct().orderBy("doc_id").collect()
    first, want = {}, {}
    for r in docs:
        words = WORDS.findall(r["text"] or "")
        gone = np.zeros(len(words), bool)
        for k in range(len(words) - width + 1):
            if first.setdefault(tuple(words[k : k + width]), r["doc_id"]) < r["doc_id"]:
                gone[k : k + width] = True
        want[r["doc_id"]] = (len(words), int(gone.sum()), " ".join(w for w, g in zip(words, gone) if not g))
    got = substring.dedup(odd, width=width).collect()
    assert len(got) == odd.count()
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_removed"], r["kept_text"]) == want[r["doc_id"]]
    assert substring.dedup(empty).count() == 0
    same = substring.rewrite(odd, width=width)
    assert same.columns == odd.columns and same.count() == odd.count()


# 6
def test_simhash(spark, odd, empty):
    def fp(text):
        w = low(text)
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for r in simhash.classes(odd).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r["fp"] & (2**64 - 1) == fp(r["text"])
    got = {r["doc_id"]: r["component_id"] for r in simhash.classes(odd).collect()}
    assert got[7] == 6 and got[4] == 3 and got[5] == 3 and got[11] == 10
    assert simhash.classes(empty).count() == 0
    kept = [r["doc_id"] for r in simhash.keep_first(odd).collect()]
    assert 7 not in kept and kept.count(6) == odd.where("doc_id = 6").count()


def test_simhash_links_are_those_of_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 20, dtype=np.uint64)
    fps = [int(c) for c in centres]
    for c in centres[:3]:
        for _ in range(300):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                x ^= 1 << int(b)
            fps.append(x)
    u = np.array(sorted(set(fps)), np.uint64)
    root = {int(x): int(x) for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in u:
        for y in u[np.bitwise_count(u ^ x) <= 2]:
            a, b = find(int(x)), find(int(y))
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(int(x) - (1 << 64) if int(x) >> 63 else int(x),) for x in u], "fp long")
    got = {r["node"] & (2**64 - 1): r["root"] & (2**64 - 1) for r in simhash.components(simhash.links(df)).collect()}
    groups = lambda f: sorted(sorted(g) for g in {}.__class__((k, [x for x in map(int, u) if f(x) == k]) for k in {f(int(x)) for x in u}).values())
    assert groups(find) == groups(lambda x: got.get(x, x))


def test_near_duplicates(spark, odd, empty):
    rng = random.Random(9)
    texts, planted = {}, []
    for k in range(200):
        words = [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(80, 600))]
        texts[k] = " ".join(words)
        if k % 2:
            for _ in range(max(1, len(words) // 100)):
                words[rng.randrange(len(words))] = "changed"
            texts[1000 + k] = " ".join(words)
            planted.append((k, 1000 + k))
    hub = [f"h{rng.randrange(3000)}" for _ in range(400)]
    for k in range(300):
        own = list(hub)
        own[rng.randrange(400)] = f"only{k}"
        texts[5000 + k] = " ".join(own)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    got = {r["doc_id"]: r["root"] for r in near.duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    alike = [(a, b) for a, b in planted if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(alike) > 60 and sum(got.get(b) == a for a, b in alike) >= 0.95 * len(alike)
    assert not {i for i in got if i < 1000} and all(got.get(i) == 5000 for i in range(5001, 5300))
    found = {r["doc_id"]: r["root"] for r in near.duplicates(odd).collect()}
    assert found == {4: 3, 5: 3, 7: 6, 11: 10}
    assert near.duplicates(empty).count() == 0 and near.keep_first(odd).columns == odd.columns


def near_classes(spark, texts):
    """Roots that the operator and brute force give, and the sets."""
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i in sorted(sets):
        for j, same in Counter(j for x in sets[i] for j in holders.get(x, ())).items():
            if same >= 0.8 * (len(sets[i]) + len(sets[j]) - same):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in sets[i]:
            holders.setdefault(x, []).append(i)
    want = {i: find(i) for i in texts if find(i) != i}
    return {r["doc_id"]: r["root"] for r in near.duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}, want


def changed(words, spots, rng):
    out = list(words)
    for k in rng.sample(range(len(out)), spots):
        out[k] = f"x{rng.randrange(10**9)}"
    return out


def test_near_duplicates_of_families(spark):
    rng = random.Random(21)
    texts = {}
    for family in range(3):
        words = [f"f{rng.randrange(3000)}" for _ in range(300)]
        for k in range(300):
            texts[1000 * family + k] = " ".join(changed(words, rng.randrange(1, 11), rng))
    got, want = near_classes(spark, texts)
    assert len(want) > 400 and got == want


def test_near_duplicates_in_long_lists(spark):
    rng = random.Random(22)
    words = [f"g{rng.randrange(3000)}" for _ in range(100)]
    texts = {k: " ".join(changed(words, rng.randrange(1, 5), rng)) for k in range(2600)}
    got, want = near_classes(spark, texts)
    assert len(want) > 1000 and got == want


def test_near_duplicates_with_edits_in_one_place(spark):
    rng = random.Random(23)
    texts, fresh = {}, lambda n: [f"y{rng.randrange(3000)}" for _ in range(n)]
    for k in range(600):
        words = fresh(300)
        texts[k] = " ".join(words)
        texts[1000 + k] = " ".join([words + fresh(73), words[:242], words[:100] + fresh(28) + words[128:]][k % 3])
    got, want = near_classes(spark, texts)
    assert len(want) == 600 and got == want


def test_near_duplicates_of_long_texts_are_exact(spark):
    rng = random.Random(24)
    texts = {}
    for k in range(60):
        words = [f"l{rng.randrange(30_000)}" for _ in range(3000)]
        texts[k] = " ".join(words)
        # Similarity 0.797 or 0.803.
        texts[1000 + k] = " ".join(words[: 2392 if k % 2 else 2410])
    got, want = near_classes(spark, texts)
    assert len(want) == 30 and got == want


# 7
def test_html(spark):
    page = """<table><caption>C</caption><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td>banana split<td>12</table><p>a<p>b<br>c<ul><li>one<li>two<ol><li>n1<li>n2</ol><li>three</ul>
x <b> y</b> z<pre> a\n  b</pre><div hidden>no</div><span style='display:none'>no</span>&copy;<style>.h{display:none}</style><i class=h>no</i><script>if(a<b)</script><!-- no"""
    assert html_layout.to_text(page).split("\n") == ["C", "Name          Qty", "apple         3", "banana split  12", "", "a", "", "b", "c", "", "- one", "- two", "  1. n1", "  2. n2", "- three", "", "x y z", "", " a", "  b", "", "©"]
    odd = ["<div>" * 5000 + "deep", "<a href='x>y", "<", "</p></x>t", "<table><td>x", "&#0;&bogus;", "<p title='a>b'>q", "<li>" * 3000, "<textarea>a<b></textarea>"]
    for h in odd:
        html_layout.to_text(h)
    assert html_layout.to_text(odd[0]) == "deep" and html_layout.to_text(odd[6]) == "q"
    df = spark.createDataFrame([(1, "<p>a", 2), (1, "<p>a", 2), (None, None, None), (3, "", 1)], "page_id long, html string, text int")
    assert sorted(collected(html_layout.extract(df)), key=str) == [(1, "a"), (1, "a"), (3, ""), (None, "")]
    assert html_layout.extract(df.limit(0)).count() == 0


def test_html_shows_what_is_visible():
    text = html_layout.to_text
    assert text("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>").split("\n") == ["A  b", "   c"]
    assert text("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b><ul><li>no</ul></div>").split() == ["yes"]
    assert text("<style>.v{visibility:hidden} .s{visibility:visible}</style><p class=v>no <i class=s>yes</i>") == "yes"
    assert text("<style>.h{display:none}/*.x{display:none}*/ @media print{.x{display:none}} @media screen{.y{display:none}}</style><p class=h>no<p class=h style='display:block'>a<p class=x>b<p class=y>no").split() == ["a", "b"]
    assert text("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>").split() == ["s", "t", "yes"]
    assert text("<table><tr><td colspan=2>wide header<tr><td>a<td>b<td>c</table>").split("\n") == ["wide header", "a  b         c"]
    assert text(f"<table><tr><td>{'x' * 100}<td>b<tr><td>y<td>c</table>").split("\n") == ["x" * 100 + "  b", "y" + " " * 101 + "c"]
    assert text(f"<table><tr><td>{'x' * 300}<td>b<tr><td>y<td>c</table>").split("\n") == ["x" * 300 + "  b", "y  c"]
    assert text("<div>" * 400 + "<table>" * 200 + "deep") == "deep" and text("<ul><li>" * 3000 + "deep").strip("- ").endswith("deep")
    assert text("<table><thead><tr><td rowspan=9>h<td>i</thead><tr><td>a<td>b</table>").split("\n") == ["h  i", "a  b"]
    assert text("<input type=hidden value=no><input type=submit value=Go><input value=x>") == "Gox"


@pytest.mark.parametrize("seed", range(30))
def test_html_tables_equal_a_brute_force_grid(seed):
    """Cells of random tables lie in the line and column where a matrix of marked places puts them."""
    rng = random.Random(seed)
    n_rows, cells, taken, html = rng.randint(1, 7), [], set(), "<table>"
    for r in range(n_rows):
        html += "<tr>"
        column = 0
        for _ in range(rng.randint(1, 5)):
            wide, high = rng.choice((1, 1, 1, 2, 3)), min(rng.choice((1, 1, 1, 2, 3)), n_rows - r)
            while (r, column) in taken:
                column += 1
            taken |= {(r + i, column + j) for i in range(high) for j in range(wide)}
            word = f"c{len(cells)}" + "x" * rng.randint(0, 12)
            cells.append((r, column, wide, word))
            html += f"<td colspan={wide} rowspan={high}>{word}"
            column += wide
    lines = html_layout.to_text(html + "</table>").split("\n")
    assert len(lines) == n_rows
    where: dict[int, set[int]] = {}
    for r, column, wide, word in cells:
        assert lines[r].split().count(word) == 1
        where.setdefault(column, set()).add((lines[r] + " ").index(word + " "))
    single = {c for _, c, w, _ in cells if w == 1}
    # All cells that start in a column start at one place; columns with cells of their own come in order.
    assert all(len(v) == 1 for v in where.values())
    starts = [min(where[c]) for c in sorted(single)]
    assert starts == sorted(set(starts))
    for r in range(n_rows):
        assert lines[r].split() == [w for q, _, _, w in cells if q == r]


# 8
def test_decontamination(spark, odd, empty):
    items = spark.createDataFrame([(1, " ".join(f"q{k}" for k in range(30)), 9), (2, "too short", 9), (3, None, 9), (4, " ".join(f"z{k}" for k in range(20)), 9), (None, "", 9)], "item_id long, text string, doc_id int")
    edited = [f"q{k}" for k in range(30)]
    edited[4] = "other"
    del edited[20]
    docs = spark.createDataFrame([(1, "a b " + " ".join(f"Q{k}," for k in range(30)) + " c", 1), (2, " ".join(["x", *edited, "y", "q1 q2 q3"]), 1), (3, "q1 q2 q3 " * 50, 1), (4, None, 1)], "doc_id long, text string, item_id int")
    got = sorted(collected(decontam.find(docs, items)))
    assert got[0] == (1, 1, 2, 30, 0) and got[1][:2] == (2, 1) and got[1][4] <= 6 and len(got) == 2
    assert [r["doc_id"] for r in decontam.clean(docs, items).orderBy("doc_id").collect()] == [3, 4]
    assert decontam.find(odd, items).count() == 0 and decontam.clean(odd, items).count() == odd.count()
    assert decontam.find(empty, items).count() == 0 and decontam.clean(docs, items.limit(0)).count() == 4


def _edited(rng, words, edits, kind, codes):
    out = list(words)
    for _ in range(edits):
        own = rng.choice(("sub", "drop", "add")) if kind == "mixed" else kind
        at = rng.randrange(len(out))
        if own == "sub":
            out[at] = rng.randrange(1, codes)
        elif own == "drop":
            del out[at]
        else:
            out.insert(at, rng.randrange(codes))
    return out


@pytest.mark.parametrize("kind", ["sub", "drop", "add", "mixed"])
def test_decontamination_recall_at_the_bound(kind):
    rng = random.Random(kind)
    items = decontam.Items([(k, " ".join(f"t{rng.randrange(600)}" for _ in range(rng.randrange(15, 60)))) for k in range(100)])
    found = 0
    for ident, words, edits in items.every:
        around = [[rng.randrange(len(items.codes)) for _ in range(40)] for _ in range(2)]
        seq = np.array(around[0] + _edited(rng, words, edits, kind, len(items.codes)) + around[1])
        found += any(x[1] == ident for x in items.find(seq, np.array([0, len(seq)])))
    assert found >= 97


def test_decontamination_equals_brute_force_over_all_runs():
    """Few words, so that chance brings many runs near the bound: pairs and edits as a scan of all texts and items gives them."""
    rng = random.Random(8)
    items = decontam.Items([(k, " ".join(f"t{rng.randrange(30)}" for _ in range(rng.choice((5, 9, 12, 20))))) for k in range(30)])
    texts = [[rng.randrange(len(items.codes)) for _ in range(rng.randrange(0, 120))] for _ in range(70)]
    for t in texts[:50]:
        _, words, edits = rng.choice(items.every)
        t[len(t) // 2 : len(t) // 2] = _edited(rng, words, rng.randrange(edits + 1), "mixed", len(items.codes))
    starts = np.cumsum([0, *map(len, texts)])
    got = {(t, i): d for t, i, _, _, d in items.find(np.array([x for t in texts for x in t]), starts)}
    want = {}
    for n, t in enumerate(texts):
        for ident, words, most in items.every:
            row, least = list(range(len(words) + 1)), len(words)
            for y in t:
                new = [0]
                for k, x in enumerate(words, 1):
                    new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (x != y)))
                row, least = new, min(least, new[-1])
            if least <= most:
                want[n, ident] = least
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.98 * len(want) > 30


def test_decontamination_embedding_follows_the_edit_distance():
    rng = np.random.default_rng(5)
    words = rng.integers(1, 500, (200, 40))
    near = words.copy()
    near[:, 11] = 501
    far = rng.integers(1, 500, (200, 40))
    at, size, way = np.arange(200) * 40, np.full(200, 40), np.ones(200, np.int64)
    a, b, c = (decontam.embed(x.reshape(-1), at, size, way, 80, 0) for x in (words, near, far))
    assert np.median((a != b).sum(axis=1)) < 10 < 50 < np.median((a != c).sum(axis=1))


def test_decontamination_names_and_ties(spark):
    items = spark.createDataFrame([(7, " ".join(f"q{k}" for k in range(10))), (7, " ".join(f"q{k}" for k in range(10)))], "doc_id long, text string")
    docs = spark.createDataFrame([("a", " ".join(f"q{k}" for k in range(10)) + " x " + " ".join(f"q{k}" for k in range(10)), 1)] * 2, "doc_id string, text string, item_doc_id int")
    got = decontam.find(docs, items, item_col="doc_id")
    assert got.columns[:2] == ["doc_id", "item_doc_id"] and set(collected(got)) == {("a", 7, 0, 10, 0)} and got.count() == 4


def test_decontamination_finds_dropped_and_added_words():
    rng = random.Random(4)
    items = decontam.Items([(k, " ".join(f"t{rng.randrange(300)}" for _ in range(rng.randrange(15, 60)))) for k in range(60)])
    for s in items.sizes:
        for i, w in enumerate(s.words):
            for kind in ("drop", "add", "both"):
                v = list(w)
                for k in range(s.edits):
                    if kind == "add" or kind == "both" and k % 2:
                        v.insert(rng.randrange(1, len(v)), 0)
                    else:
                        del v[rng.randrange(len(v))]
                seq = np.array([0] * 70 + v + [0] * 70)
                got = [x for x in items.find(seq, np.array([0, len(seq)])) if x[1] == s.ids[i]]
                assert len(got) == 1 and abs(got[0][2] - 70) <= s.edits and got[0][4] <= s.edits, (kind, len(w))


def test_decontamination_finds_short_items_unchanged():
    items = decontam.Items([(1, "what is the capital of France?"), (2, "...")])
    what, of = [items.codes[w] for w in "what is the capital of france".split()], items.codes["of"]
    assert [*items.find(np.array([0, *what, 0]), np.array([0, 8]))] == [(0, 1, 1, 6, 0)]
    assert not [*items.find(np.array([0, *what[:3], of, *what[4:], 0]), np.array([0, 8]))]


# 9
def test_packing(spark, odd, empty):
    out = packing.pack(odd).toPandas()
    assert len(packing.pack(empty).take(1)) == 0
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 4096 and (g.offset.to_numpy() == np.cumsum(g.length) - g.length).all()
    encoder = wordbpe.Encoder(wordbpe.vocabulary_path())
    for r in odd.where("doc_id IN (1, 3, 4, 8, 9)").collect():
        want = [*encoder.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        own = out[out.doc_id == r["doc_id"]].sort_values("start")
        assert np.frombuffer(b"".join(own.ids), "<u4").tolist() == want and set(own.doc_tokens) == {len(want)}


def test_best_fit_is_the_tightest():
    rng = random.Random(2)
    lengths = [rng.randint(1, 100) for _ in range(400)]
    where, offset, n = packing.best_fit(lengths, 100)
    room = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        best = min((r for r in room if r >= lengths[i]), default=None)
        if best is None:
            room.append(100 - lengths[i])
        else:
            room[room.index(best)] = best - lengths[i]
    assert n == len(room) and sum(lengths) / n / 100 > 0.95
    used = Counter()
    for w, k in zip(where, lengths):
        used[w] += k
    assert max(used.values()) <= 100


# 10
def test_wavelet(spark, odd, empty, tmp_path):
    out = wavelet.round_trip(odd).collect()
    assert len(out) == odd.count() and wavelet.round_trip(empty).count() == 0
    tokenizer = wordbpe.Encoder(wordbpe.vocabulary_path()).tokenizer
    texts = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    start = 0
    for (i, t), r in zip(texts, sorted(out, key=lambda r: r["start"])):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    rng = np.random.default_rng(1)
    for ids in (np.array([2], np.uint32), np.full(1000, 7, np.uint32), (rng.zipf(1.2, 200_000) % 49408).astype(np.uint32)):
        path = str(tmp_path / "x.wm")
        wavelet.write(path, ids, pa.array([5]), np.array([len(ids)]))
        s = wavelet.Shard(path)
        assert (s.decode() == ids).all()
        for i in rng.integers(0, len(ids), 20):
            t, lo, hi = int(ids[i]), *sorted(rng.integers(0, len(ids) + 1, 2).tolist())
            at = np.flatnonzero(ids == t)
            assert s.token(int(i)) == t and s.count(t, lo, hi) == ((at >= lo) & (at < hi)).sum()
            j = int(rng.integers(0, len(at)))
            assert s.locate(t, j) == at[j]
        assert s.count(60_000) == 0


# helpers
def test_blobs_and_windows():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    cols = packed.decode(packed.encode([keys, np.arange(len(keys)), keys.astype(np.uint32)]))
    assert all((a == b).all() for a, b in zip(cols, [keys, np.arange(len(keys)), keys.astype(np.uint32)]))
    h = rng.integers(0, 5, 300).astype(np.uint64)
    for width in (1, 2, 7, 20, 50):
        got, want = textops.windows(h, width), {}
        assert len(got) == 301 - width
        for k, g in enumerate(got.tolist()):
            assert want.setdefault(tuple(h[k : k + width].tolist()), g) == g
        assert len(set(want.values())) == len(want)
    flat, starts = textops.split(pa.array([" A b\x0bc ", None, "", "\x85d"]), lower=True)
    assert flat.to_pylist() == ["a", "b", "c", "\x85d"] and starts.tolist() == [0, 3, 3, 3, 4]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
