"""Operators on pages and vectors, components, and packed blocks, held against plain Python."""

import base64
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from pyspark.sql import functions as F

from linkspark.llm import blocks, components, embedding_dedup, grouping, hashing, url_filter, warc

PAGES = "page_id long, url string, html string"


def pages():
    return [
        (1, "https://a.example.com/en/7/x?q#f", "<p>same</p>"),
        (2, "http://EXAMPLE.com/en/8", "<p>same</p>"),
        (3, "ftp://b.net/de/81", "<p>other é</p>"),
        (4, None, None),
        (5, "nothing", ""),
        (6, "http://org/es/", "x" * 300_000),
        (7, "http://x.example.net/de/8?//", "\r\n\r\nWARC/1.1\r\n"),
        (8, "http://x.org/ES/", "<p>same</p>"),
        (8, "http://x.org/ES/", "<p>same</p>"),
        (None, "http://com\n/en/", "<p>same</p>"),
        (None, "://com/en/#", "alone"),
        (9, "http://notcom/en/", "z"),
        (10, "http://com/en", "z"),
    ]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(pages(), PAGES).repartition(3)


# ---- WARC


def test_archives(spark, table, tmp_path):
    path = f"file://{tmp_path}/warc"
    warc.write_archives(table, path)
    got = sorted(map(tuple, warc.read_archives(spark, path).select("page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload").collect()), key=str)
    want = []
    for page_id, _, html in pages():
        data = (html or "").encode()
        same = [i for i, _, h in pages() if (h or "") == (html or "") and i is not None]
        response = not same or page_id == max(same)
        name = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((page_id, "response" if response else "revisit", len(data), name, None if response else max(same), bytearray(data if response else b"")))
    assert got == sorted(want, key=str)
    assert warc.read_archives(spark, path).filter("target_uri like '%\\n%'").count() == 0


def test_archives_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 100_000)
    rnd = random.Random(2)
    rows = [(k, f"http://a/{k}", rnd.randbytes(size).hex()) for k, size in enumerate([20_000] * 40 + [1_500_000, 10, 10])]
    path = f"file://{tmp_path}/warc"
    warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), path)
    sizes = sorted(p.stat().st_size for p in (tmp_path / "warc").glob("part-*"))
    assert len(sizes) > 8 and sizes[-2] < 140_000 < sizes[-1]
    got = warc.read_archives(spark, path).select("page_id", "payload").collect()
    assert {r.page_id: bytes(r.payload).decode() for r in got} == {k: html for k, _, html in rows}


def test_no_pages(spark, tmp_path):
    path = f"file://{tmp_path}/warc"
    warc.write_archives(spark.createDataFrame([], PAGES), path)
    assert warc.read_archives(spark, path).count() == 0


def archive(records, dictionary=b"WARC/1.1\r\nContent-Length: some dictionary"):
    encoder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    return warc.dictionary_frame(dictionary) + b"".join(encoder.compress(r) + warc.EMPTY_FRAME.encode() for r in records)


def test_reader_on_files_of_others():
    record = warc.record(5, "http://a/", b"payload", False, None)
    assert [(f["warc-type"], n, body) for f, n, body in warc.read_archive(archive([record]))] == [("response", 7, b"payload")]
    dictionary = b"WARC/1.1\r\nContent-Length: some dictionary"
    packed = warc.dictionary_frame(zstandard.ZstdCompressor().compress(dictionary))
    assert list(warc.read_archive(packed + archive([record])[8 + len(dictionary) :]))
    rle = zstandard.ZstdCompressor().compress(bytes(400_000))
    assert [len(f) for _, f in warc.frames(memoryview(rle + rle))] == [len(rle)] * 2


@pytest.mark.parametrize("damage", [lambda r: r[:-1], lambda r: r + b"x", lambda r: r.replace(b"payload", b"changed"), lambda r: r.replace(b"WARC/1.1", b"WARC/0.1"), lambda r: r.replace(b"Content-Length: ", b"Content-Length: 1")])
def test_damaged_records(damage):
    with pytest.raises(ValueError):
        list(warc.read_archive(archive([damage(warc.record(5, "http://a/", b"payload", False, None))])))


def test_damaged_frames():
    whole = archive([warc.record(5, "http://a/", b"payload", False, None)])
    for bad in (whole[:-9], b"\0" + whole, whole[whole.index(warc.FRAME) :]):
        with pytest.raises((ValueError, IndexError, zstandard.ZstdError)):
            list(warc.read_archive(bad))


# ---- URLs


def slow_judge(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url and at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3] if fits else None, max(fits)[4] if fits else "allow")


@pytest.mark.parametrize("most", [100, 0])
def test_urls(table, most):
    rules = [*url_filter.RULES, ("block", "", "/es/"), ("allow", "x.org", ""), ("block", "x.org", "/"), ("allow", "x.org", "/")]
    for use in (list(url_filter.RULES), rules, []):
        got = sorted((tuple(r) for r in url_filter.filter_urls(table, use, max_broadcast=most if use else 100).collect()), key=str)
        assert got == sorted(((i, *slow_judge(u, use)) for i, u, _ in pages()), key=str)


def test_long_urls_and_clashing_names(spark):
    rows = [(1, "http://" + "a." * 100_000 + "example.com/en/7" + "/x" * 100_000, "net/"), (2, "http://EXAMPLE.com/en/" + "7" * 500_000, "allow")]
    table = spark.createDataFrame(rows, "page_id long, url string, rule string").selectExpr("*", "'x' AS host", "'y' AS path", "'z' AS verdict")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(table).collect()}
    assert got == {i: slow_judge(u, list(url_filter.RULES)) for i, u, _ in rows}


def test_embeddings_with_clashing_names(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (None, [1.0, 0.05], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", *[f"'x' AS `{c}`" for c in ("class", "digest", "weight", "vector", "size", "cell", "chunk", "lo", "hi", "links")])
    got = sorted(map(tuple, embedding_dedup.near_duplicates(table).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, False)], key=str)


def test_no_urls(spark):
    assert url_filter.filter_urls(spark.createDataFrame([], PAGES)).count() == 0


# ---- embeddings


def vectors():
    rnd = np.random.default_rng(3)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            base = rnd.normal(size=8)
            for _ in range(rnd.integers(1, 6)):
                rows.append((k, [float(np.float32(x)) for x in base + rnd.normal(size=8) * 0.07], label))
                k += 1
    rows += [(k, list(rows[0][1]), 0), (k + 1, list(rows[0][1]), 1), (k + 2, None, 0), (k + 3, [], 0), (k + 4, [0.0] * 8, 0), (k + 5, [float("nan")] + [1.0] * 7, 0), (k + 6, [None] + [1.0] * 7, 0), (k + 7, [float("inf")] * 8, 0), (k + 8, [2 * x for x in rows[0][1]], 0), (k + 9, [1.0, 2.0], 0), (k + 10, [2.0, 4.0], 0)]
    return rows


@pytest.mark.parametrize("chunk", [2048, 7])
def test_embeddings(spark, monkeypatch, chunk):
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    rows = vectors()
    ok = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = (label, np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)))
    links = {i: [j for j in ok if j != i and ok[j][0] == ok[i][0] and len(ok[j][1]) == len(ok[i][1]) and ok[i][1] @ ok[j][1] >= 0.98] for i in ok}
    least = {i: i for i, _, _ in rows}
    for _ in rows:
        for i in ok:
            least[i] = min([least[i], *(least[j] for j in links[i])])
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(table).collect()}
    assert got == {i: (len(links.get(i, [])), least[i], least[i] == i) for i, _, _ in rows}
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("cells", [1, 3])
def test_embeddings_by_cells(spark, monkeypatch, cells):
    monkeypatch.setattr(embedding_dedup, "CHUNK", 40)
    monkeypatch.setattr(embedding_dedup, "MAX_CELLS", cells)
    rnd = np.random.default_rng(cells)
    x = np.concatenate([rnd.normal(size=(200, 4)), np.repeat(rnd.normal(size=(3, 4)), 50, axis=0) + rnd.normal(size=(150, 4)) * 0.02])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = unit @ unit.T >= 0.98
    np.fill_diagonal(linked, False)
    table = spark.createDataFrame([(k, v, 0) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(table).collect()}
    assert got == {k: (int(linked[k].sum()), int(c)) for k, c in enumerate(components.matrix_groups(linked))}


def tree_points(n, spread):
    rnd = np.random.default_rng(1)
    return embedding_dedup.Points(np.concatenate([rnd.normal(size=(n, 16)), np.repeat(rnd.normal(size=(20, 16)), n // 10, axis=0) + rnd.normal(size=(2 * n, 16)) * spread]))


def test_cover_tree_holds_its_bounds():
    points = tree_points(100, 0.01)
    tree = embedding_dedup.cover_tree(points, np.arange(300), 0.2)

    def check(node, radius):
        far = np.linalg.norm(points.unit[node.members] - points.unit[node.center], axis=1)
        assert far.max() <= node.reach + 1e-7
        assert node.reach <= radius + 1e-7 or not node.below
        if node.below:
            assert sorted(m for n in node.below for m in n.members) == sorted(node.members)
            for n in node.below:
                check(n, radius / 2)

    check(tree, 2.0)
    met, whole = set(), set()
    for x, y, every in embedding_dedup.dual_pairs(points, tree, tree, 0.2):
        for a in x.tolist():
            for b in y.tolist():
                if a != b:
                    (whole if every else met).add((min(a, b), max(a, b)))
    near = {(a, b) for a in range(300) for b in range(a + 1, 300) if np.linalg.norm(points.unit[a] - points.unit[b]) <= 0.2}
    assert whole and whole <= near and not whole & met and near <= whole | met


def test_cover_tree_saves_distances():
    points = tree_points(1000, 0.005)
    n = len(points.unit)
    tree = embedding_dedup.cover_tree(points, np.arange(n), 0.2)
    for x, y, whole in embedding_dedup.dual_pairs(points, tree, tree, 0.2):
        points.taken += 0 if whole else len(x) * len(y)
    assert points.taken < n * n / 4


def test_cells_lose_no_neighbour():
    points = tree_points(300, 0.05).unit
    home, visits = embedding_dedup.cells_of(points, points[:40], 0.2)
    for a in range(len(points)):
        for b in range(a):
            if np.linalg.norm(points[a] - points[b]) <= 0.2 and home[a] != home[b]:
                x, y = (a, b) if home[a] < home[b] else (b, a)
                assert home[y] in visits[x]


# ---- groups


@pytest.mark.parametrize("alike", [True, False])
def test_groups_grow_without_their_square(spark, alike):
    seen = spark.sparkContext.accumulator(0)

    def link(table):
        seen.add(table.num_rows)
        ids = np.sort(np.asarray(table.column("id")))
        linked = np.ones((len(ids),) * 2, bool) if alike else np.abs(ids[:, None] - ids[None, :]) == 300
        return pa.table([pa.array(ids[k].repeat(1)) for k in np.nonzero(np.triu(linked, 1))], ["a", "b"])

    rows = spark.range(600).withColumn("k", F.lit(1))
    joined = components.components(grouping.group_edges(rows, ["k"], "id", "1", 16, link))
    got = {r.node: r.label for r in joined.collect()}
    assert got == {x: 0 if alike else x % 300 for x in range(600)}
    if alike:  # 600 rows in 38 chunks, the first one met by each
        assert seen.value < 3 * 600 + 600


# ---- components


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(70)] + [(5000, 5000 + k) for k in range(50)] + [(7, 7)] * 3
    label = {}

    def root(x):
        label.setdefault(x, x)
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    table = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.label for r in components.components(table).collect()}
    assert got == {x: root(x) for x in label}
    assert components.components(table.limit(0)).count() == 0


def test_tree_edges_keep_components():
    groups, ids = np.array([0] * 100 + [1] * 3 + [2]), np.arange(104)[::-1]
    edges = list(components.tree_edges(groups, ids))
    assert len(edges) == 99 + 2 and all(a < b for a, b in edges)
    assert max(np.bincount([x for e in edges for x in e])) <= components.FAN + 1


# ---- hashes and blocks


def test_words_and_shingles():
    text = "aB  ab\x0bAB é\x00 aB"
    assert hashing.words_of(text) == re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    assert hashing.words_of(text, lower=True) == [b"ab", b"ab", b"ab", "é\x00".encode(), b"ab"]
    assert hashing.words_of(None) == hashing.words_of(" \n") == []
    assert hashing.shingles_of([b"a", b"b", b"a", b"b"], 2) == {(b"a", b"b"), (b"b", b"a")}
    assert hashing.shingles_of([b"a"], 2) == {(b"a",)} and hashing.shingles_of([], 2) == set()


def test_hashes_are_sums_and_polynomials():
    rnd = random.Random(1)
    h = hashing.WordHashes(3)
    words = [bytes(rnd.randrange(33, 256) for _ in range(rnd.choice([1, 2, 3, 4, 5, 7, 8, 9, 16, 31, 64, 65, 200]))) for _ in range(300)]

    def slow(w):
        if len(w) > 64:
            return h._hash(w)
        return (len(w) * h.factors[-1] + sum(int.from_bytes(w[k : k + 4], "little") * h.factors[k // 4] for k in range(0, len(w), 4))) % hashing.PRIME

    values = h.of(words)
    assert values.tolist() == [slow(w) for w in words] and not len(h.of([]))
    values[:3] = [hashing.PRIME - 1, 0, hashing.PRIME - 1]
    for n in (1, 2, 3, 5, 7, 20, 300, 301):
        want = [sum(int(v) * pow(h.base, n - 1 - j, hashing.PRIME) for j, v in enumerate(values[k : k + n])) % hashing.PRIME for k in range(len(words) - n + 1)]
        assert h.windows(values, n).tolist() == hashing.mix(np.array(want, np.uint64)).tolist()
    assert set(hashing.WordHashes(4).of(words).tolist()).isdisjoint(h.of(words).tolist())


def test_runs_of_buckets():
    assert blocks.runs(np.array([2, 2, 5, 9, 9, 9])) == {2: slice(0, 2), 5: slice(2, 3), 9: slice(3, 6)}
    assert blocks.runs(np.empty(0, np.int64)) == {}


def test_packed_numbers():
    rnd = np.random.default_rng(2)
    x = np.sort(rnd.integers(0, 2**64, 1000, dtype=np.uint64))
    assert np.array_equal(blocks.unpack_sorted(blocks.pack_sorted(x)), x)
    for y in (np.empty(0, np.int64), np.array([-5, 2**40], np.int64)):
        assert np.array_equal(blocks.unpack_numbers(blocks.pack_numbers(y), np.int64), y)


def test_blocks_keep_rows(spark, monkeypatch):
    rows = [(k, "x" * (k % 7) * 50 if k % 5 else None) for k in range(200)] + [(999, "y" * 50_000)]
    table = spark.createDataFrame(rows, "k long, text string").repartition(2)
    packed = blocks.pack_rows(table, block_bytes=2000).collect()
    back = [(r["k"], r["text"]) for p in packed for r in blocks.unpack_rows(bytes(p.data)).to_pylist()]
    assert sorted(back) == sorted(rows) and len({p.block for p in packed}) == len(packed) > 10
    assert blocks.pack_rows(table.limit(0)).count() == 0
    assert pa.types.is_string(blocks.unpack_rows(bytes(packed[0].data)).schema.field("text").type)


def test_buckets_follow_bytes(spark, tmp_path, monkeypatch):
    spark.range(1000).write.parquet(str(tmp_path / "d"))
    table = spark.read.parquet(str(tmp_path / "d"))
    size = blocks.input_bytes(table.filter("id > 3").select("id"))
    assert size == sum(p.stat().st_size for p in (tmp_path / "d").glob("*.parquet"))
    few = blocks.buckets(table)
    monkeypatch.setattr(blocks, "BUCKET_BYTES", 1)
    assert blocks.buckets(table) >= size > few and blocks.buckets(table) & (blocks.buckets(table) - 1) == 0
    assert blocks.input_bytes(spark.createDataFrame([("abc",), (None,)], "t string")) == 3 + 2 * 8
