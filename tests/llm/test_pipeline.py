"""Every stage of the corpus pipeline against a plain version, each on its own input, and queries against their SQL."""

import collections
import re
import zlib

import duckdb
import numpy as np
import pytest

pytest.importorskip("lumenq.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from lumenq.llm import queries  # noqa: E402

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """The smallest documents, a few benchmark passages, near copies and odd rows, in a folder that run() reads, too."""
    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [r.asDict() for r in frame.collect()]
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if r.text and len(r.text.split()) >= 5]
    r = np.random.default_rng(3)
    long = [x for x in rows if x["text"] and len(x["text"].split()) > 60]
    more = [x | {"text": x["text"] + " tail"} for x in long[:4]] + [x | {"text": " ".join(x["text"].split()[30:] + items[k].split())} for k, x in enumerate(long[4:8])]
    more += [long[9] | {"text": t} for t in (None, "", " \n", "Ein Wort")] + [long[10]]
    rows += [x | {"doc_id": 10**6 + k} for k, x in enumerate(more)]
    rows += [long[11], long[12] | {"doc_id": None}, long[13] | {"doc_id": 10**6 + 50, "source": None}]
    r.shuffle(rows)
    out = spark.createDataFrame(rows, frame.schema)
    folder = str(tmp_path_factory.mktemp("pipeline"))
    out.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), folder


def bag(rows):
    return collections.Counter((r.doc_id, r.text, r.source) for r in rows)


def base_failed(t):
    w = WORD.findall(t or "")
    grams = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    again = {p for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
    return len(w) < 20 or 100 * len(again) > 30 * len(w)


def test_quality(spark, docs):
    docs, folder = docs
    rows, kept = docs.collect(), corpus_pipeline.quality(spark, docs, folder)
    left = kept.collect()
    good = bag(r for r in rows if not base_failed(r.text))
    assert kept.columns == docs.columns and not bag(left) - good
    assert sum(bag(left).values()) >= 0.95 * sum(good.values())


def test_near_duplicates(spark, docs):
    docs, folder = docs
    rows, kept = docs.collect(), corpus_pipeline.near_duplicates(spark, docs, folder)
    sets = []
    for r in rows:
        w = WORD.findall((r.text or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset()))
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            same = len(a & sets[j])
            if same and 100 * same >= 80 * (len(a) + len(sets[j]) - same) and rows[i].doc_id is not None and rows[j].doc_id is not None:
                parent[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[top(i)] = min(least.get(top(i), r.doc_id), r.doc_id)
    named = {(r.doc_id, r.text, r.source) for i, r in enumerate(rows) if r.doc_id is not None and (least[top(i)] == r.doc_id or not sets[i])}
    known = {s for s, r in zip(sets, rows, strict=True) if r.doc_id is not None}
    want = collections.Counter(named) + collections.Counter({(None, r.text, r.source) for s, r in zip(sets, rows, strict=True) if r.doc_id is None and s not in known})
    assert kept.columns == docs.columns and bag(kept.collect()) == want and sum(want.values()) < len(rows)


def plain_tiles(a, b, least=5):
    """Greedy string tiling by the longest run of unmarked words, again and again: how many words of a are covered."""
    marked_a, marked_b = [False] * len(a), [False] * len(b)
    covered = 0
    while True:
        best, before = (0, 0, 0), [0] * (len(b) + 1)
        for i in range(len(a)):
            now = [0] * (len(b) + 1)
            for j in range(len(b)):
                if a[i] == b[j] and not marked_a[i] and not marked_b[j]:
                    now[j + 1] = before[j] + 1
                    best = max(best, (now[j + 1], -i, -j))
            before = now
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return covered
        marked_a[i - n + 1 : i + 1], marked_b[j - n + 1 : j + 1] = [True] * n, [True] * n
        covered += n


def test_decontamination(spark, docs):
    docs, folder = docs
    words = lambda t: re.findall(r"(?:[a-zA-Z0-9]|[^\x00-\x7f])+", (t or "").translate(LOWER))
    items = [words(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    items = [x for x in items if len(x) >= 5]
    grams = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in items]
    rows, want = docs.collect(), []
    for r in rows:
        w = words(r.text)
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        # tiles of at least five words lie in shared seeds, so fewer shared seeds than this cannot cover enough
        if not any(5 * len(own & g) >= 0.8 * len(x) and plain_tiles(x, w) >= 0.8 * len(x) for x, g in zip(items, grams, strict=True)):
            want.append(r)
    kept = corpus_pipeline.decontamination(spark, docs, folder)
    assert kept.columns == docs.columns and bag(kept.collect()) == bag(want) and len(want) <= len(rows) - 4


def test_mix_and_shards(spark, docs):
    docs, folder = docs
    rows, mixed = docs.collect(), corpus_pipeline.mix(spark, docs, folder)
    taken = mixed.collect()
    copies, there = bag(taken), bag(rows)
    size = lambda x: len(WORD.findall(x[1] or ""))
    assert mixed.columns == docs.columns and all(n <= 2 * there[x] for x, n in copies.items())
    total = {s: sum(size(x) * n for x, n in there.items() if x[2] == s) for s in {x[2] for x in there}}
    names = sorted(total, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, [[5, 2, 1][k % 3] for k in range(len(names))], strict=True))
    open_, rest, target = set(names), 1.5 * sum(total.values()), {}
    while True:
        full = {s for s in open_ if rest * goal[s] / sum(goal[x] for x in open_) > 2 * total[s]}
        if not full:
            break
        for s in full:
            target[s] = 2 * total[s]
        rest, open_ = rest - sum(target[s] for s in full), open_ - full
    target |= {s: rest * goal[s] / sum(goal[x] for x in open_) for s in open_}
    for s in names:
        most = max(size(x) for x in there if x[2] == s)
        assert abs(sum(size(x) * n for x, n in copies.items() if x[2] == s) - target[s]) <= most
    out = corpus_pipeline.shards(spark, mixed, folder).collect()
    crc = lambda t: zlib.crc32((t or "").encode())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in out) == collections.Counter((r.doc_id, len((r.text or "").encode()) + 1, crc(r.text)) for r in taken)
    of = collections.defaultdict(set)
    for r in out:
        of[r.text_crc32, r.size].add(r.shard)
    assert all(len(x) == 1 for x in of.values())
    loads = collections.Counter()
    for r in out:
        loads[r.shard] += r.size
    largest = max(sum(r.size for r in out if (r.text_crc32, r.size) == k) for k in of)
    assert set(loads) == set(range(8)) and max(loads.values()) <= sum(loads.values()) / 8 + largest
    for k in range(8):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))


def test_run(spark, docs):
    _, folder = docs
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and {r.shard for r in out} <= set(range(8)) and not {r.doc_id for r in out} & {10**6 + k for k in range(13)}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = db.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, DATA)
    order = sorted(want.columns)
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    rows = collections.Counter(tuple(plain(r[c]) for c in order) for r in got.collect())
    assert sorted(got.columns) == order
    assert rows == collections.Counter(tuple(plain(dict(zip(want.columns, r, strict=True))[c]) for c in order) for r in want.fetchall())
