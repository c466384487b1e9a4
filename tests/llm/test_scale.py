"""What must not depend on how many rules, shards, copies or items there are."""

import base64
import collections
import time

import numpy as np
import pytest

pytest.importorskip("lumenq.llm")
from pyspark.sql import functions as F  # noqa: E402

from lumenq.llm import compression, graph, mixing, ngramjoin, sharding, tiling, urls  # noqa: E402
from lumenq.llm.columns import Scratch, written  # noqa: E402


def plain_rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.text), len(r.host), r.host, r.path, not r.allow)) if fits else None


@pytest.mark.parametrize("inline", [True, False])
def test_rules_and_aliases(spark, monkeypatch, inline):
    monkeypatch.setattr(urls, "INLINE", 10**6 if inline else 0)
    r = np.random.default_rng(4)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "x.org", "org", "", "a", "deep.x.org"]
    rules = [urls.Rule(bool(r.integers(2)), f"{hosts[r.integers(2, 8)] if k % 3 else hosts[r.integers(0, 2)]}/{'pq'[r.integers(2)] * int(r.integers(0, 4))}") for k in range(40)]
    rules = [x for x in rules if x.host]
    pages = []
    for i in range(150):
        url = [None, "no url", "http://", "HTTP://A.com"][i] if i < 4 else f"http://{hosts[r.integers(8)]}/{'pq'[r.integers(2)] * int(r.integers(0, 5))}{['', '?q=1', '#f', '/z'][r.integers(4)]}"
        other = f"http://{hosts[r.integers(8)]}/alias{r.integers(12)}"
        html = [None, "", f'<link rel="canonical" href="{other}">', f'<meta http-equiv="refresh" content="0; url={other}">'][r.integers(4)]
        pages.append((i, url, html, "clash", "clash", True))
    pages += pages[10:12]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, node string, rule string, said boolean")
    redirects = [("http://one.net/", "http://two.net/"), ("http://two.net/", "http://b.a.com/p"), (None, "http://one.net/")]
    got = urls.judge(frame, rules, redirects=spark.createDataFrame(redirects, "src string, dst string")).collect()
    assert len(got) == len(pages)

    def split(url):
        if url is None or "://" not in url:
            return "", "", None
        scheme, rest = url.split("://", 1)
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("#")[0]
        bare = path.split("?")[0]
        return host, bare, f"{scheme.lower()}://{host}{bare or '/'}" + ("?" + path.split("?", 1)[1] if "?" in path else "")

    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for _, url, html, *_ in pages:
        for to in urls.page_links(url, html):
            u, v = split(url)[2], split(to)[2]
            if u and v:
                parent[top(u)] = top(v)
    for u, v in redirects:
        if u and v:
            parent[top(split(u)[2])] = top(split(v)[2])
    said = collections.defaultdict(set)
    for x in list(parent):
        rule = plain_rule(*split(x)[:2], rules)
        if rule:
            said[top(x)].add(any(y.allow is False for y in rules if y.text == rule.text))
    for g in got:
        url = dict((p[0], p[1]) for p in pages)[g.id]
        host, path, node = split(url)
        rule = plain_rule(host, path, rules)
        blocked = any(y.allow is False for y in rules if rule and y.text == rule.text)
        if rule is None:
            blocked = node in parent and said[top(node)] == {True}
        assert (g.host, g.path, g.rule, g.verdict) == (host, path, rule.text if rule else None, "block" if blocked else "allow"), (url, rule)
    assert urls.judge(frame.limit(0), rules).count() == 0


def test_many_rules(spark):
    rules = [urls.Rule(k % 3 == 0, f"h{k % 500}.net/{k}") for k in range(20_000)] + [urls.Rule(False, "net/")]
    frame = spark.createDataFrame([(k, f"http://w.h{k % 500}.net/{k * 7}") for k in range(200)], "page_id long, url string")
    got = urls.judge(frame, rules, html_col=None).collect()
    by = collections.defaultdict(list)
    for r in rules:
        by[r.host].append(r)
    for g in got:
        host = g.host
        want = plain_rule(host, g.path, [r for h in (host, host[2:], "net") for r in by.get(h, [])])
        assert g.rule == want.text and g.verdict == ("allow" if want.allow else "block")


def test_components(spark):
    r = np.random.default_rng(1)
    edges = [(f"n{a}", f"n{b}") for a, b in r.integers(0, 300, (200, 2))] + [(f"hub{k % 2}", f"m{k}") for k in range(300)] + [(f"c{k}", f"c{k + 1}") for k in range(40)] + [("s", "s"), ("d", "e"), ("d", "e")]
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[top(a)] = top(b)
    least = {}
    for x in list(parent):
        least[top(x)] = min(least.get(top(x), x), x)
    assert got == {x: least[top(x)] for x in list(parent)}


def test_thousands_of_shards(spark):
    ends = np.cumsum(np.random.default_rng(2).integers(1, 50, 20_000))
    cuts = sorted(set(np.random.default_rng(3).choice(ends[:-1], 9_999, replace=False).tolist())) + [int(ends[-1])]
    groups = spark.createDataFrame([(int(e),) for e in ends], "end long")
    got = {r.end: r.shard for r in sharding.placed(groups, cuts).collect()}
    assert all(got[int(e)] == w for e, w in zip(ends, np.searchsorted(cuts[:-1], ends, side="left"), strict=True))
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(4000)], "doc_id long, text string")
    began = time.time()
    rows = sharding.shard(docs, 3000).collect()
    assert {r.shard for r in rows} <= set(range(3000)) and len(rows) == 4000 and time.time() - began < 120
    for k in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == k)
        assert own == list(range(len(own)))


def test_a_hot_text_is_split(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LARGE_GROUP", 50)
    docs = spark.createDataFrame([(None if i % 10 == 0 else i, "same" if i % 3 else f"text {i}") for i in range(600)], "doc_id long, text string")
    out = sharding.shard(docs, 4)
    rows = out.collect()
    for k in range(4):
        own = sorted(r.slot for r in rows if r.shard == k)
        assert own == list(range(len(own)))
    assert len(rows) == 600 and len({r.shard for r in rows if r.size == 5}) == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(atom" in plan and "part" in plan and "REPARTITION_BY_COL" in plan


def test_the_mix_has_as_many_rows_as_copies(spark):
    r = np.random.default_rng(0)
    rows = [(i % 150 if i % 4 else None, " ".join(["w"] * int(r.integers(0, 40))) + (" x" if i % 5 else ""), f"s{i % 3}" if i % 7 else None, "k") for i in range(900)]
    docs = spark.createDataFrame([*rows, *rows[:200]], "doc_id long, text string, source string, size string")
    found, out = mixing.mix(docs), mixing.mixed(docs)
    size = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long")
    want = {tuple(x)[:3]: x.n for x in found.groupBy("id", "source", "size").agg(F.sum("copies").alias("n")).filter("n > 0").collect()}
    got = {tuple(x)[:3]: x.n for x in out.groupBy("doc_id", "source", size.alias("z")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert want == got and out.columns == docs.columns


def test_items_that_begin_alike(spark):
    start = "which of the following statements"
    items = [(i, f"{start} " + " ".join(f"w{i}x{k}" for k in range(20))) for i in range(3000)]
    docs = spark.createDataFrame([(i, f"{start} is this about {i}") for i in range(300)] + [(900, "so " + items[7][1] + " it is")], "doc_id long, text string")
    began = time.time()
    got = tiling.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(g.doc_id, g.item_id) for g in got] == [(900, 7)] and time.time() - began < 60
    with pytest.raises(ValueError):
        tiling.Settings(seed=6, min_tile=5)


@pytest.mark.parametrize("words", [30, 100, 300, 1000, 5000])
def test_noise_is_rejected(spark, words):
    r = np.random.default_rng(words)
    n = 8 * words

    def spaced(x):
        return " ".join(x[i : i + 7] for i in range(0, n, 8))

    noise = {"base64": spaced(base64.b64encode(r.bytes(n)).decode()), "bytes": spaced("".join(chr(c) for c in r.integers(33, 127, n))), "loop": " ".join(f"{k % 9}word" for k in range(words))}
    if words >= 300:
        noise["hex"] = spaced(r.bytes(n).hex())
        letters = "".join(r.choice(list("etaoinshrdlu"), n))
        noise["half"] = " ".join(f"the {letters[i : i + 5]} is" for i in range(0, n // 2, 8)) + " " + spaced(base64.b64encode(r.bytes(n)).decode())[: n // 2]
    docs = spark.createDataFrame(list(enumerate(noise.values())), "doc_id long, body string")
    kept = {x.doc_id: x.kept for x in compression.scores(docs, text_col="body").collect()}
    assert {k: kept[i] for i, k in enumerate(noise)} == dict.fromkeys(noise, False)


def test_clean_prose_is_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = compression.scores(docs).filter("NOT base_failed")
    n, rejected = found.count(), found.filter("reason LIKE 'incompressible%'").count()
    assert rejected <= 0.01 * n


def test_a_large_benchmark_is_joined(spark):
    r = np.random.default_rng(12)
    vocabulary = [f"v{k}" for k in range(40)]
    start = "which of the following statements"
    texts = [f"{start} " + " ".join(r.choice(vocabulary, int(n))) for n in r.integers(1, 40, 60)] + ["one two", "", None, "Same, item here is THIS one", start]
    items = [(i if i % 9 else None, t, "clash", 1) for i, t in enumerate(texts)] + [(500, texts[3], "clash", 2), (3, texts[3], "clash", 3)]
    docs = [None, "", start, "one two"]
    for i in range(200):
        w = (texts[int(r.integers(60))] + " " + texts[int(r.integers(60))]).split()
        k = int(r.integers(len(w)))
        w = w[k:] + ["between"] * int(r.integers(2)) + w[:k]  # reordered
        for at in r.choice(len(w), int(r.integers(0, 4))):
            w[at] = "edited"
        docs.append(" ".join(["before"] * int(r.integers(3)) + w).upper() if i % 2 else ", ".join(w))
    rows = [(i if i % 11 else None, t, "x", "y") for i, t in enumerate(docs)]
    frame = spark.createDataFrame([*rows, *rows[:40]], "doc_id long, text string, f string, k string")
    bench = spark.createDataFrame(items, "item_id long, text string, t string, n_words long")
    small, large = (sorted(map(repr, tiling.leaks(frame, bench, block_bytes=n).collect())) for n in (1 << 20, 0))
    assert small == large and len(small) > 50
    kept = [collections.Counter(map(repr, tiling.clean(frame, bench, block_bytes=n).collect())) for n in (1 << 20, 0)]
    assert kept[0] == kept[1] and 0 < sum(kept[0].values()) < len(rows) + 40
    assert tiling.leaks(frame.limit(0), bench, block_bytes=0).count() == 0 and tiling.clean(frame, bench.limit(0), block_bytes=-1).count() == len(rows) + 40


def test_texts_of_the_mix_and_of_kept_documents_are_not_shuffled(spark):
    """Not even where no table is broadcast by its size: what is shuffled stays far below the texts."""
    r = np.random.default_rng(8)
    rows = [(i, " ".join("%016x" % x for x in r.integers(0, 2**62, 150)), ["a", "b", None][i % 3]) for i in range(1500)]
    rows += [(2000 + i, rows[i][1], "a") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = written(docs, "test-not-shuffled")
    size = sum(len(t) for _, t, _ in rows)
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before, limit = shuffled(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        written(mixing.mixed(docs), "test-mixed")
        after_mix = shuffled()
        found = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") < 2000, F.col("doc_id")).otherwise(F.col("doc_id") - 2000).alias("first"))
        scratch = Scratch(spark, "test-gone")
        kept = ngramjoin._without(docs, "doc_id", found.filter("id != first").select("id"), found.filter("id = first").select("id"), scratch)
        assert sorted(x.doc_id for x in written(kept, "test-kept").select("doc_id").collect()) == list(range(1500))
        scratch.clear()
        assert after_mix - before < size / 4 and shuffled() - after_mix < size / 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
