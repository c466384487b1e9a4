"""The text operators against plain versions, over documents with every odd case."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("lumenq.llm")
from lumenq.llm import compression, licenses, lm, mixing, ngramjoin, packing, sharding, tiling, urls, wordscan  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, g long"


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdeorst"), 5)) for _ in range(n))


BASE = prose(1, 120)
TEXTS = [BASE, BASE, BASE.replace(BASE.split()[60], "changed"), prose(2, 200), None, "", " \n\t", "a", "a b", "A  B", "word " * 90, BASE + " " + prose(3, 60), prose(4, 30) + " " + " ".join(BASE.split()[20:90]), "é ü\x0bñ " * 9, prose(5, 3000), "Released under the MIT License. " + prose(6, 40)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, None if i == 3 else f"s{i % 4}", None, "k", None, 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def test_quality(docs, empty):
    got = {r.doc_id: r for r in compression.scores(docs).collect()}
    for i, t in enumerate(TEXTS):
        w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        grams = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {p for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        assert (got[i].n_words, got[i].word_chars, got[i].n_dup_lines, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(again))
        assert got[i].base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w))
    assert compression.kept(docs).columns == docs.columns and compression.kept(docs).filter("doc_id = 3").count() == 2
    assert not got[10].kept and got[3].kept and compression.scores(empty).count() == 0


def test_incompressible(spark):
    import base64

    def noise(n):
        return base64.b64encode(np.random.default_rng(n).bytes(n)).decode()[:n]

    def spaced(n):
        t = noise(n)
        return " ".join(t[i : i + 10] for i in range(0, n, 10))[:n]

    sizes = (300, 500, 600, 1000, 1024, 2000, 4000, 4096, 6000, 20000)
    mixed = [prose(41, 700) + " " + spaced(4200), spaced(4200) + " " + prose(42, 700), prose(43, 200) + " " + spaced(900)]
    plain = [prose(50 + n, n // 6) for n in sizes if n >= 300]
    texts = [*map(spaced, sizes), *mixed, *plain]
    rows = compression.scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    bad = len(sizes) + len(mixed)
    assert {r.doc_id for r in rows if r.reason and r.reason.startswith("incompressible")} == set(range(bad))
    assert all(r.kept for r in rows if r.doc_id >= bad)


def test_tiles():
    a, b = list(range(30)), [90, *range(15, 30), 91, 92, *range(15)]
    assert sorted(tiling.tiles(a, b, list(range(len(b))), 5)) == [(0, 18, 15), (15, 1, 15)]


def test_decontamination(spark, docs, empty):
    w = BASE.split()
    items = spark.createDataFrame([(1, " ".join(w[60:90] + w[20:50])), (2, prose(9, 40)), (3, None), (4, "a b")], "item_id long, text string")
    for block in (1 << 20, 100):
        assert {(r.doc_id, r.item_id) for r in tiling.leaks(docs, items, block_bytes=block).collect()} == {(i, 1) for i in (0, 1, 2, 11, 12)}
    assert {r.doc_id for r in tiling.clean(docs, items).collect()} == {i for i in range(len(TEXTS))} - {0, 1, 2, 11, 12}
    assert tiling.leaks(docs, items.filter("false")).count() == 0 and tiling.leaks(empty, items).count() == 0


def test_licenses(docs, empty):
    assert [(r.doc_id, r.license_id, r.start_word, r.end_word) for r in licenses.scan(docs).collect()] == [(15, "mit-line", 0, 5)]
    assert licenses.scan(empty).count() == 0


def test_edited_licenses():
    import pyarrow as pa

    t = licenses.Templates(licenses.TEMPLATES, licenses.Settings())
    r, texts = np.random.default_rng(8), []
    k = t.ids.index("gpl-3.0")
    plain = re.findall(r"[A-Za-z0-9]+", licenses.TEMPLATES[k][1])
    while len(texts) < 600:
        w = list(plain)
        for at in r.choice(len(w), 3, replace=False):
            w[at] = f"edit{at}"
        text = " ".join([prose(len(texts), 60), *w, prose(7000 + len(texts), 60)])
        own = licenses.shingles(wordscan.utf8_runs([text]), 5)[0]
        if 0.8 <= np.isin(t.sets[k], own).mean() < 0.84:
            texts.append(text)
    assert {row for row, which, *_ in licenses._scan(pa.array(texts), t) if which == k} == set(range(len(texts)))


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS) + 1 and all(r.taken <= 2 * r.size for r in rows)
    targets = {r.source: r.target for r in rows}
    assert math.isclose(sum(targets.values()), 1.5 * sum(r.size for r in rows))
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed(docs).count() == sum(r.copies for r in rows)


def test_sharding(docs, empty):
    rows = sharding.shard(docs, 3).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and len(rows) == len(TEXTS) + 1
    assert len({r.shard for r in rows if r.id in (0, 1)}) == 1
    assert {r.id: r.text_crc32 for r in rows} == {i: zlib.crc32((t or "").encode()) for i, t in enumerate(TEXTS)}
    assert sharding.shard(empty).count() == 0


@pytest.mark.parametrize("points", [16, 1000])
def test_capacity(spark, points):
    sizes = np.random.default_rng(7).integers(1, 50, 300).tolist()
    ends = np.cumsum(sizes).tolist()

    def shards(c):
        n, now = 1, 0
        for x in sizes:
            n, now = (n, now + x) if now + x <= c else (n + 1, x)
        return n

    best = next(c for c in range(max(sizes), sum(sizes) + 1) if shards(c) <= 5)
    found, cuts = sharding.capacity_and_cuts(spark.createDataFrame([(e,) for e in ends], "end long"), 5, points)
    assert found == best and set(cuts) <= set(ends)


def test_ngram_join(docs, empty):
    sets = {}
    for i, t in enumerate(TEXTS):
        w = words(t)
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set())
    want = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                same = len(sets[a] & sets[b])
                if same and 100 * same >= 90 * len(sets[a] | sets[b]):
                    want[a] = want[b] = min(want[a], want[b])
    got = ngramjoin.join(docs, settings=ngramjoin.Settings(words=3, percent=90)).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets} and len(got) == len(TEXTS) + 1
    assert ngramjoin.join(empty).count() == 0
    assert {r.doc_id for r in ngramjoin.first_of_each(docs, settings=ngramjoin.Settings(words=3, percent=90)).collect()} == {i for i in sets if want[i] == i}


def test_one_row_of_each_component_stays(spark):
    a, b, c = prose(31, 60), prose(32, 60), prose(33, 60)
    rows = [(1, a), (1, a), (2, a), (3, b), (3, b), (3, b), (None, b), (None, c), (None, c), (4, ""), (None, "")]
    left = ngramjoin.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.text) for r in left) == collections.Counter([(1, a), (3, b), (None, c), (4, ""), (None, "")])


def test_ngram_join_within_groups(spark):
    rows, want = [], {}
    for k in range(30):
        x = prose(700 + k, 22).split()
        y = ["first", *x[1:-1], "last"]
        texts = [x, y, [*y[:-1], "other"]]
        rows += [(3 * k + i, " ".join(w)) for i, w in enumerate(texts)]
        sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in texts]
        linked = {(i, j) for i in range(3) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])}
        assert linked == {(2, 1)}
        want |= {3 * k: 3 * k, 3 * k + 1: 3 * k + 1, 3 * k + 2: 3 * k + 1}
    got = ngramjoin.join(spark.createDataFrame(rows, "doc_id long, text string"), settings=ngramjoin.Settings(words=3, percent=90)).collect()
    assert {r.id: r.component_id for r in got} == want


def test_token_files(docs, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(public.path("byte_bpe_50k.json"))
    t, at = Tokenizer.from_file(path), 0
    got = sorted(packing.pack_and_digest(docs, path, settings=packing.Settings(length=16, rows=4)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([*range(len(TEXTS)), 3])
    for r in got:
        ids = np.array([*t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert packing.pack_and_digest(empty, path).count() == 0


def test_language_model(docs, empty):
    model = lm.train(docs.filter(~lm.held_out("doc_id")).select("text"))
    rows = lm.scores(docs, model).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {i: [*words(t), None] for i, t in enumerate(TEXTS)}
    learnt = [tokens[i] for i in [*range(len(TEXTS)), 3] if not held(i)]
    c = collections.Counter(w for x in learnt for w in x)
    n, v = sum(c.values()), len(c)
    for r in rows:
        x = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(x), sum(c[w] > 0 for w in x), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), rel_tol=1e-9) and r.score < 0
    assert len(rows) == len(TEXTS) + 1
    nothing = lm.train(empty.select("text"))
    assert all(math.isclose(r.score, 0.0) or r.score < 0 for r in lm.scores(docs, nothing).collect())


def kneser_ney(learnt, order):
    """The model by its definition, over lists of tokens: a function from a list to its log10 probability."""
    counts = {order: collections.Counter(tuple(x[i : i + order]) for x in ([0] * (order - 1) + x for x in learnt) for i in range(len(x) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter()
        for g, c in counts[k + 1].items():
            counts[k][g[1:]] += c if k > 1 and g[1] == 0 else 1
    followers = collections.defaultdict(list)
    for k in counts:
        for g, c in counts[k].items():
            followers[g[:-1]].append(c)
    discount = {}
    for k, own in counts.items():
        n = [sum(c == j for c in own.values()) for j in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
        raw = [j - (j + 1) * y * n[j] / n[j - 1] if n[j - 1] else 0.5 * j for j in (1, 2, 3)]
        discount[k] = [0, *[min(max(d, 0.05), j - 0.05) for j, d in enumerate(raw, 1)]]
    distinct = len({w for x in learnt for w in x})

    def p(g):
        if not g:
            return 1 / (distinct + 1)
        d, after = discount[len(g)], followers.get(g[:-1])
        if not after:
            return p(g[1:])
        c, total = counts[len(g)][g], sum(after)
        return max(c - d[min(c, 3)], 0) / total + sum(d[min(x, 3)] for x in after) / total * p(g[1:])

    return lambda x: sum(math.log10(p(tuple(([0] * (order - 1) + x)[i : i + order]))) for i in range(len(x)))


@pytest.mark.parametrize(("order", "shard"), [(3, 2_000_000), (2, 8), (3, 8), (4, 50)])
def test_language_model_by_definition(docs, monkeypatch, order, shard):
    """Small shards: many words are too frequent for one, so contexts are spread over shards, and words have several shards."""
    monkeypatch.setattr(lm, "SHARD", shard)
    got = lm.scores(docs, lm.train(docs.filter(~lm.held_out("doc_id")).select("text"), order)).collect()
    tokens = {i: [*words(t), None] for i, t in enumerate(TEXTS)}
    plain = kneser_ney([tokens[i] for i in [*range(len(TEXTS)), 3] if zlib.crc32(str(i).encode()) % 7 != 2], order)
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert math.isclose(r.score, plain(tokens[r.doc_id]), rel_tol=1e-9)


def test_each_context_is_looked_up_once(spark, monkeypatch):
    """One context with 90 words after it, one of them 300 times, and others with a few; the scores are those of the definition."""
    texts = [" ".join(f"the w{(7 * i + j) % 90} of" for j in range(12)) for i in range(30)] + ["the w1 " * 300, "the", "x y the w91 z"]
    model = lm.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    seen, places = [], lm._places
    monkeypatch.setattr(lm, "_places", lambda arrays, at: seen.append(at.tolist()) or places(arrays, at))
    score = lm.Scorer(model).score(wordscan.utf8_runs(texts))[3]
    plain = kneser_ney([[*words(t), None] for t in texts], 3)
    assert all(math.isclose(s, plain([*words(t), None]), rel_tol=1e-9) for s, t in zip(score, texts, strict=True))
    assert seen and all(len(x) == len(set(x)) for x in seen)


def test_urls(spark):
    rules = [urls.Rule(True, "org/"), urls.Rule(False, "bad.com/"), urls.Rule(True, "bad.com/ok")]
    link = '<html><head><link href="{}" rel=canonical></head>'
    pages = [(1, "http://x.org/a?b", None), (2, "http://Sub.BAD.com/a", ""), (3, "http://alias.net/1", link.format("http://bad.com/z")), (4, "http://two.net/", '<meta http-equiv="refresh" content="0; url=http://alias.net/1">'), (5, None, "x"), (6, "nothing", "x"), (7, "http://bad.com/okay", ""), (8, "http://c.net/p", link.format("/q")), (9, "http://d.net", link.format("http://x.org/m"))]
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert got[1] == ("x.org", "/a", "org/", "allow") and got[2] == ("sub.bad.com", "/a", "bad.com/", "block")
    assert got[3][2:] == (None, "block") and got[4][2:] == (None, "block") and got[5] == ("", "", None, "allow") == got[6]
    assert got[7][2:] == ("bad.com/ok", "allow") and got[8][3] == "allow" and got[9][3] == "allow"


def test_links_behind_quotes_and_entities(spark):
    links = ['<link title="a > b" rel="canonical" href="http://bad.com/1">', '<LINK rel="&#99;anonical" href="http://bad.com/2">', '<meta name="a>b" content="0; url=http://bad.com/3" http-equiv="refresh">']
    pages = [(i, f"http://alias{i}.net/", f"<html><head>{x}</head>") for i, x in enumerate(links)]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), [urls.Rule(False, "bad.com/")]).collect()
    assert {(r.id, r.verdict) for r in got} == {(i, "block") for i in range(len(links))}


def test_word_hashes_do_not_depend_on_the_run():
    import pyarrow as pa

    for run in wordscan.runs(pa.array(["x y", "y", "Y"])):
        w = wordscan.words(run)
        h = wordscan.span_hashes(run, w.start, w.end, lower=True)
        assert h[1] == h[2] == h[3] != h[0]


def test_encoder_is_the_plain_tokenizer():
    import public_tokenizers

    from lumenq.llm.packing import Encoder

    odd = ["it's, don't. x's!!", "a 1,2  3..", " 's", "S,", " ,\n,,a\n\n b, ", "café's%%% 中文, ǅ,", "", "\n", "word,\n.word -,-a", "a\tb c d  e", "one two\nthree one two"]
    for most in (800_000, 2):
        encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"), most)
        for _ in range(2):
            for text, ids in zip(odd, encoder.encode(odd), strict=True):
                assert np.frombuffer(ids, dtype=np.uint16).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text
