"""Token files, periodic runs, fill-in-the-middle."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
import pytest
from cases import WORD, awkward, documents, prose
from conftest import DATA
from ledgerwatch.llm import catalog, infill, periodic, token_files
from ledgerwatch.llm.wavelet import WaveletMatrix
from pyspark.sql import functions as F


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


# token files


@pytest.mark.parametrize("source", [documents, awkward])
def test_token_files_hold_every_id_in_order(spark, tmp_path, source):
    from tokenizers import Tokenizer

    plain, docs = Tokenizer.from_file(catalog.tokenizer_file()), source(spark)
    path = token_files.write_token_files(docs, str(tmp_path / "t"), catalog.tokenizer_file(), files=7)
    want = Counter()
    for r in docs.collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [1]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = sorted(token_files.checksums(spark, path).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)
    assert {(r.doc_id, r.start, r.n_tokens) for r in token_files.read_numbers(spark, path).collect()} == {(r.doc_id, r.start, r.n_tokens) for r in got}


def test_token_file_format(spark, tmp_path):
    path = token_files.write_token_files(documents(spark), str(tmp_path / "t"), catalog.tokenizer_file(), files=2)
    files = ds.dataset(f"{path}/ids").files
    assert len(files) == 2
    for f in files:
        group = pq.ParquetFile(f).metadata.row_group(0)
        columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert columns["ids.list.element"].has_dictionary_page and "RLE_DICTIONARY" in columns["ids.list.element"].encodings
        for name in ("part", "doc_id", "start", "n_tokens"):
            assert "DELTA_BINARY_PACKED" in columns[name].encodings and not columns[name].has_dictionary_page
            assert columns[name].has_column_index and columns[name].has_offset_index


def test_token_files_are_read_in_part(spark, tmp_path, capsys):
    path = token_files.write_token_files(documents(spark), str(tmp_path / "t"), catalog.tokenizer_file(), files=5)
    everything = {r.doc_id: (r.start, r.ids) for r in token_files.read_documents(spark, path, F.lit(True)).collect()}
    stream = [i for start, ids in sorted(everything.values()) for i in ids]
    some = token_files.read_documents(spark, path, "doc_id between 20 and 29")
    assert {r.doc_id: (r.start, r.ids) for r in some.collect()} == {k: v for k, v in everything.items() if 20 <= k <= 29}
    some.explain("formatted")
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(doc_id,20\)", capsys.readouterr().out)
    token_files.read_numbers(spark, path).explain("formatted")
    assert "ids:array" not in capsys.readouterr().out
    for a, b in ((0, len(stream)), (0, 1), (5, 5), (1000, 30_000), (len(stream) - 3, len(stream) + 9), (len(stream), len(stream) + 1), (777, 778)):
        got = sorted((r.start, r.n_tokens, r.ids) for r in token_files.read_stretch(spark, path, a, b).collect())
        assert [i for _, _, ids in got for i in ids] == stream[a:b]
        assert all(len(ids) == n for _, n, ids in got) and (not got or got[0][0] == a)


def test_token_files_of_nothing_and_of_one_key(spark, tmp_path):
    file = catalog.tokenizer_file()
    empty = token_files.write_token_files(documents(spark).limit(0), str(tmp_path / "a"), file)
    assert token_files.checksums(spark, empty).count() == 0 and token_files.read_stretch(spark, empty, 0, 9).count() == 0
    one = spark.createDataFrame([(7, "the same words")] * 2000 + [(7, f"other {i}") for i in range(100)], "doc_id bigint, text string")
    path = token_files.write_token_files(one, str(tmp_path / "b"), file, files=4)
    parts = token_files.read_parts(spark, path).collect()
    assert len(parts) == 4 and max(p.documents for p in parts) < 900 and sum(p.documents for p in parts) == 2100


# periodic runs


def plain_runs(w):
    """All runs by looking at every period: (start, length, period)."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(12, 2 * q):
                found.setdefault((i, length), q)  # the smallest period comes first
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_result(key, text, planted=True):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(key if key is not None else "").encode())
    n, g = len(w), h // 10
    if planted and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (
        key, len(runs), s, length, q, 1000 * length // q if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
        sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def morse(n):
    return ["ab"[bin(i).count("1") % 2] for i in range(n)]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def repetitive():
    rng = random.Random(11)
    texts = [morse(3000), fibonacci(3000), ["x"] * 700, ["x"] * 11, ["x"] * 12, list("ab") * 6, list("abcdef") * 2, list("abcdefg") * 2, (["a"] * 20 + ["b"]) * 9, list("aab") * 40 + list("aba") * 40]
    for _ in range(150):
        w = []
        while len(w) < rng.choice([30, 200, 900]):
            unit = [rng.choice("abcd" if rng.random() < 0.5 else "uvwxyzklmno") for _ in range(rng.randint(1, 40))]
            w += (unit * rng.randint(1, 9))[: rng.randint(1, 400)]
        texts.append(w)
    return texts


def test_runs_equal_brute_force(monkeypatch):
    texts = repetitive()
    for tile in (4096, 16, 64):  # also with many tiles to a text
        monkeypatch.setattr(periodic, "TILE", tile)
        size, found = periodic.fragments(pa.array([" ".join(t) for t in texts]))
        assert size.tolist() == [len(t) for t in texts]
        got = {}
        for row, q, a, b in sorted(found.tolist(), key=lambda r: (r[0], r[1], r[2])):
            spans = got.setdefault((row, q), [])
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        for i, t in enumerate(texts):
            assert sorted((a, b - a + q, q) for (row, q), spans in got.items() if row == i for a, b in spans) == plain_runs(t), (tile, i)


@pytest.mark.parametrize("tile", [4096, 32])
def test_run_query_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(periodic, "TILE", tile)
    docs = documents(spark).select("doc_id", "text")
    more = spark.createDataFrame([(10_000 + i, " ".join(t)) for i, t in enumerate(repetitive()[2:40])], "doc_id bigint, text string")
    docs = docs.where("length(text) < 4000").union(more)
    solved = catalog.run_digests(periodic.periodic_runs(docs, order=catalog.planted_order))
    want = [plain_result(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, solved.collect())) == sorted(want)
    assert sum(r[1] > 0 for r in want) > 30 and solved.columns[0] == "doc_id"


def test_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "start " + "round and " * 9 + "stop"), (2, "nothing here\n twice")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in periodic.periodic_runs(docs).collect()}
    assert got[1].collapsed == "start round and stop" and [tuple(x) for x in got[1].runs] == [(1, 18, 2)]
    assert got[2].collapsed is None and got[2].runs == [] and got[2].collapsed_sha256 == sha("nothing here twice")


def test_runs_of_awkward_rows(spark):
    docs = awkward(spark)
    got = sorted((tuple(r) for r in catalog.run_digests(periodic.periodic_runs(docs, order=catalog.planted_order)).collect()), key=repr)
    rows = [r for r in docs.collect() if r.doc_id != 9]
    want = sorted((plain_result(r.doc_id, r.text) for r in rows), key=repr)
    assert [g for g in got if g[0] != 9] == want and len(got) == docs.count()
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_a_long_unary_text_gives_one_run(spark):
    text = "word " * 200_000 + "end"
    (r,) = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert [tuple(x) for x in r.runs] == [(0, 200_000, 1)] and r.collapsed == "word end"


# fill in the middle


def plain_infill(key, text):
    text = text or ""
    h = [int(sha(f"1:{'' if key is None else key}")[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return key, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return key, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_wavelet_ranks():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000):
        kinds = rng.integers(0, 8, n).astype(np.uint8)
        tree = WaveletMatrix(kinds)
        a, b = np.sort(rng.integers(0, n + 1, (2, 50)), axis=0)
        for k in range(8):
            assert tree.rank(k, a, b).tolist() == [int((kinds[i:j] == k).sum()) for i, j in zip(a, b, strict=True)]
        for some in ((1, 4), (0, 1, 2, 3, 4, 6), tuple(range(8))):
            assert tree.ranks(some, a, b).tolist() == [int(np.isin(kinds[i:j], some).sum()) for i, j in zip(a, b, strict=True)]


def test_cuts_at_words():
    rng = random.Random(5)
    texts = ["", "one", "  two words ", "ß日本 éé a\tb\nc", " \n "] + [prose(i, rng.randint(1, 60)) for i in range(20)]
    encoded = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(encoded), np.uint8), np.cumsum([0, *map(len, encoded)])
    first, second = (np.array([rng.getrandbits(32) for _ in texts]) for _ in range(2))
    units, low, high = infill.cut_places(data, offsets, first, second, "word")
    for i, t in enumerate(encoded):
        starts = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
        assert units[i] == len(starts)
        for got, c in zip((low[i], high[i]), sorted(int(h[i]) % (len(starts) + 1) for h in (first, second)), strict=True):
            assert got - offsets[i] == (0 if c == 0 else [*starts, len(t)][c])


@pytest.mark.parametrize("source", [documents, awkward])
def test_infill_equals_plain_code(spark, source):
    docs = source(spark).select("doc_id", "text")
    marked = spark.createDataFrame([(500 + i, t) for i, t in enumerate(["a<P>b", "<S>", "x <M", "<", "<<S", "P><S", "日<本>é", "a\nb"] * 9)], "doc_id bigint, text string")
    docs = docs.union(marked)
    got = infill.fill_in_middle(docs)
    rows = [tuple(r) for r in got.collect()]
    want = [plain_infill(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert {r[2] for r in rows} == {"plain", "psm", "spm"}
    back = got.select("doc_id", infill.restored(F.col("output"), F.col("form")).alias("t"))
    assert Counter((r.doc_id, r.t) for r in back.collect()) == Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert infill.fill_in_middle(docs.limit(0)).count() == 0


def test_registered_queries_restore_every_text(spark):
    texts = {r.doc_id: r.text or "" for r in documents(spark).collect()}
    for r in catalog.op13_fill_in_middle(spark, DATA).collect():
        assert r.restored_sha256 == sha(texts[r.doc_id]) and r.output_sha256 == sha(plain_infill(r.doc_id, texts[r.doc_id])[5])
    assert catalog.op11_token_files(spark, DATA).count() == len(texts)
