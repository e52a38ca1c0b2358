"""Near duplicates, decontamination, lattice scores, packing, pipeline."""

import math
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from cases import WORD, awkward, documents, low, prose
from conftest import DATA
from ledgerwatch.llm import catalog, darts, decontaminate, lattice, lm, neardup, nnls, packing, wand
from ledgerwatch.llm.frames import table
from pyspark.sql import functions as F


def shingle_set(text, n=5):
    w = WORD.findall(low(text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)])


def plain_classes(rows):
    """Sets of doc_id by brute force over all pairs with words in common."""
    sets = {r.doc_id: shingle_set(r.text) for r in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        common = Counter(j for x in s for j in holders[x])
        for j, c in common.items():
            if c >= 0.8 * (len(s) + len(sets[j]) - c):
                parent[find(i)] = find(j)
        for x in s:
            holders[x].append(i)
    out = defaultdict(set)
    for i in sets:
        out[find(i)].add(i)
    return {frozenset(x) for x in out.values()}


def test_near_duplicates_equal_brute_force(spark):
    docs = documents(spark)
    family = spark.createDataFrame([(10_000 + i, " ".join(f"v{i}" if j % 160 == i else w for j, w in enumerate(prose(77, 160).split()))) for i in range(40)], "doc_id bigint, text string")
    docs = docs.select("doc_id", "text").union(family)
    got = defaultdict(set)
    for r in neardup.near_duplicates(docs).collect():
        got[r.class_id].add(r.doc_id)
    assert {frozenset(x) for x in got.values()} == plain_classes(docs.collect()) and all(k == min(v) for k, v in got.items())


def test_families_below_the_similarity_are_told_apart(spark):
    base = prose(5, 200).split()
    rows = [(i, " ".join(f"w{i}x{j}" if (j * 7 + i) % 40 == 0 else w for j, w in enumerate(base))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = defaultdict(set)
    for r in neardup.near_duplicates(docs).collect():
        got[r.class_id].add(r.doc_id)
    assert {frozenset(x) for x in got.values()} == plain_classes(docs.collect())


def test_counted_shingles(spark):
    text = prose(1, 30)
    docs = spark.createDataFrame([(1, f"{text} {text} {text}"), (2, f"{text} {text} {text} end"), (3, f"{text} {text}")], "doc_id bigint, text string")
    by_set = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    by_count = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs, weight="count").collect()}
    assert by_set == {1: 1, 2: 1, 3: 1} and by_count == {1: 1, 2: 1, 3: 3}


def test_near_duplicates_awkward_rows(spark):
    docs = awkward(spark)
    found = neardup.near_duplicates(docs)
    assert found.count() == docs.count()
    same = {(r.doc_id, r.class_id, r.copy_id, r.n_copies) for r in found.collect()}
    assert {(5, 4, 5, 1), (1, 1, 1, 1), (2, 2, 2, 1), (None, None, None, 1)} <= same
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter([None, None, 1, 2, 3, 4, 4, 6, 7, 8, 9, 10])  # 4 has two different texts
    assert neardup.near_duplicates(docs.limit(0)).count() == 0 and neardup.drop_near_duplicates(docs.limit(0)).count() == 0


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        n = int(rng.integers(10, 400))
        keys, a, b = rng.integers(1, 2**63, n, dtype=np.uint64), rng.integers(0, 5, n) * rng.random(n), rng.integers(0, 4, n) * rng.random(n)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        sig = darts.signatures(np.repeat([0, 1], n), np.concatenate([keys, keys]), np.concatenate([a, b]), 2, 256)
        errors.append((sig[0] == sig[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    assert (darts.signatures(np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0), 2, 8) == darts.EMPTY).all()


def test_long_sketches_of_small_sets_agree():
    rng = np.random.default_rng(3)
    keys = rng.integers(1, 2**63, (200, 5), dtype=np.uint64)
    rows = np.repeat(np.arange(400), [5, 4] * 200)
    both = np.concatenate([x for k in keys for x in (k, k[:4])])
    sig = darts.signatures(rows, both, np.ones(len(rows)), 400, neardup.LONG)
    agree = (sig[::2] == sig[1::2]).mean(axis=1)  # similarity 0.8
    assert abs(agree.mean() - 0.8) < 0.01 and agree.min() > 0.7
    alone = np.concatenate([darts.signatures(np.zeros(4, int), k[:4], np.ones(4), 1, neardup.LONG) for k in keys])
    assert (alone == sig[1::2]).mean() > 0.999  # a set's sketch does not depend on its batch


def test_block_max_wand_equals_exhaustive_search():
    rng = np.random.default_rng(2)
    entries = [rng.integers(1, 400, int(rng.integers(3, 50)), dtype=np.uint64) ** np.uint64(7) for _ in range(90)]
    index = wand.BlockMaxIndex(entries, *wand.document_frequency(entries), len(entries), float(np.mean([len(e) for e in entries])), 0.4)
    for i in range(300):
        query = index.lookup(np.concatenate([entries[i % 90][: int(rng.integers(0, 40))], rng.integers(1, 400, 30, dtype=np.uint64) ** np.uint64(7)]))
        scores = np.zeros(index.n_entries)
        for t in np.unique(query[query >= 0]):
            at = slice(index.starts[t], index.starts[t + 1])
            scores[index.entry[at]] += index.impact[at]
        want = set(np.flatnonzero(scores >= 0.4 - 1e-9).tolist())
        assert {e for e, _ in index.search(query)} == want
        assert not want or len(index.candidates(np.zeros(len(query), np.int64), query))


def test_leaks_are_found_and_clean_texts_left(spark):
    docs, items = documents(spark), table(spark, DATA, "benchmark")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaked_items(docs, items).collect()}
    texts = {r.item_id: r.text for r in items.collect()}
    assert got == {(d.doc_id, i) for d in docs.collect() for i, t in texts.items() if t in d.text} and got
    kept = decontaminate.drop_leaked(docs, items)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in got}


def test_changed_and_partial_leaks(spark, monkeypatch):
    q, a = prose(31, 30), prose(32, 12)
    items = spark.createDataFrame([(1, f"{q}\n{a}"), (2, prose(33, 150)), (3, None), (4, ""), (5, prose(33, 150)), (None, prose(34, 20))], "item_id bigint, text string")
    shouted = ", ".join(q.upper().split()) + "! " + a
    rows = [(1, prose(40, 300) + " " + shouted + " " + prose(41, 300)), (2, prose(42, 500)), (3, prose(43, 77) + " " + prose(33, 150)), (4, None), (5, ""), (6, f"{q}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {(1, 1), (3, 2), (3, 5), (6, 1)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaked_items(docs, items).collect()} == want
    monkeypatch.setattr(decontaminate, "SHARD_CHARS", 300)  # several shards
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaked_items(docs, items).collect()} == want
    odd = awkward(spark)
    assert decontaminate.drop_leaked(odd, items).count() == odd.count() and decontaminate.drop_leaked(odd, items).columns == odd.columns
    assert decontaminate.leaked_items(odd, items.limit(0)).count() == 0 and decontaminate.leaked_items(odd.limit(0), items).count() == 0


def test_questions_answers_and_stretches_leak_alone(spark):
    parts = [(11, 43), (8, 37), (5, 11), (60, 9), (4, 40), (40, 3)]
    texts = [f"{prose(800 + i, q)}\n{prose(850 + i, a)}" for i, (q, a) in enumerate(parts)] + [prose(890, 150)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    words = texts[-1].split()
    held = {
        **{f"q{i}": (x.split("\n")[0], {i} if parts[i][0] >= 5 else set()) for i, x in enumerate(texts[:-1])},
        **{f"a{i}": (x.split("\n")[1], {i} if parts[i][1] >= 8 else set()) for i, x in enumerate(texts[:-1])},
        **{f"s{at}": (" ".join(words[at : at + 50]), {6}) for at in range(0, 101, 10)},
        **{f"r{at}": (" ".join(words[at : at + 24]), {6}) for at in range(0, 127, 7)},
        "few": (" ".join(words[30:42]), set()), "half": (" ".join(texts[2].split("\n")[0].split()[:4]), set()),
    }
    for before in (0, 61, 90):
        rows = [(k, f"{prose(900 + n, before)} {x} {prose(990 + n, 120)}") for n, (k, (x, _)) in enumerate(held.items())]
        got = decontaminate.leaked_items(spark.createDataFrame(rows, "doc_id string, text string"), items).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(k, i) for k, (_, found) in held.items() for i in found}


VOCABULARY = lattice.Vocabulary.load(catalog.tokenizer_file("piece_bpe_32k.model"))


def test_lattice_sums_all_segmentations():
    ids = {p: i for i, p in enumerate(VOCABULARY.pieces) if i > 2 and len(p) <= lattice.LONGEST and not re.fullmatch("<0x..>", p)}

    def marginal(word, score):
        a = [1.0] + [0.0] * (len(word) + 1)
        s = lattice.MARK + word
        for end in range(1, len(s) + 1):
            for size in range(1, min(end, lattice.LONGEST) + 1):
                piece = ids.get(s[end - size : end])
                if piece is not None:
                    a[end] += a[end - size] * math.exp(score[piece])
                elif size == 1:
                    a[end] += a[end - 1] * math.exp(sum(score[VOCABULARY.bytes[b]] for b in s[end - 1].encode()))
        return math.log(a[-1])

    words = ["the", "thanedble,", "größe", "x", "日本語ä", "a" * 30, "😀ab", "tion", "q" * 300]
    got = lattice.log_probabilities(words, VOCABULARY, VOCABULARY.start)
    assert np.allclose(got[:-1], [marginal(w, VOCABULARY.start) for w in words[:-1]]) and np.isfinite(got[-1])
    # expected counts are the derivative of the log probability by the score of a piece
    count = lattice.expected_counts(["thanedble"], np.ones(1), VOCABULARY, VOCABULARY.start)
    for piece in np.argsort(-count)[:6]:
        up = VOCABULARY.start.copy()
        up[piece] += 1e-6
        slope = (marginal("thanedble", up) - marginal("thanedble", VOCABULARY.start)) / 1e-6
        assert slope == pytest.approx(count[piece], abs=1e-3)


@pytest.mark.parametrize("source", [documents, awkward])
def test_lattice_scores_base_and_total(spark, source):
    docs = source(spark)
    rows = [(r.doc_id, WORD.findall(low(r.text or ""))) for r in docs.collect()]
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 7 == 2
    counts, ends = Counter(), 0
    for d, words in rows:
        if not held(d):
            counts.update(words)
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    base = lambda ws: sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
    want = Counter((d, held(d), len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, n, round(base(ws), 4)) for d, ws in rows)
    got = lm.score_texts(docs, catalog.tokenizer_file("piece_bpe_32k.model")).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_lattice_scores_without_training_rows(spark):
    docs = spark.createDataFrame([(i, f"word{i}") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id int, text string")
    got = lm.score_texts(docs, catalog.tokenizer_file("piece_bpe_32k.model")).collect()
    assert got and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score < 0 for r in got)
    assert lm.score_texts(docs.limit(0), catalog.tokenizer_file("piece_bpe_32k.model")).count() == 0


def test_least_squares_and_plans():
    rng = np.random.default_rng(4)
    for _ in range(20):
        a, b = rng.random((12, 20)), rng.random(12) * 5
        x = nnls.nnls(a, b)
        gradient = a.T @ (b - a @ x)
        assert (x >= 0).all() and (gradient < 1e-6).all() and abs(gradient @ x) < 1e-6
    assert all(sum(c) == 32 for c in nnls.combinations(32, 4)) and len(nnls.combinations(6, 3)) == 3 + 3
    for trial in range(12):
        lengths = rng.lognormal(6.5, 1.3, 3000).astype(int) + 1 if trial % 2 else rng.choice([1280, 1300, 70, 10], 3000)
        counts = Counter(m for i, n in enumerate(lengths.tolist()) for _, m in packing.cut(n, i % 2 == 0))
        places, ranks = defaultdict(list), defaultdict(list)
        for length, first, last, sequence, offset in packing.plan_intervals(counts):
            for rank in range(first, last + 1):
                ranks[length].append(rank)
                places[sequence + rank - first].append((offset, length))
        assert all(sorted(ranks[x]) == list(range(counts[x])) for x in counts)
        assert sorted(places) == list(range(len(places)))
        for pieces in places.values():
            end = 0
            for offset, length in sorted(pieces):
                assert offset == end
                end += length
            assert end <= packing.WINDOW
        if trial % 2:
            assert sum(lengths) / (len(places) * packing.WINDOW) > 0.995


@pytest.mark.parametrize("source", [documents, awkward])
def test_packing_keeps_every_id(spark, source):
    from tokenizers import Tokenizer

    file = catalog.tokenizer_file()
    plain = Tokenizer.from_file(file)
    docs = source(spark)
    got, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, file).collect():
        got[r.doc_id].append((r.doc_tokens, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
    want = defaultdict(list)
    for r in docs.collect():
        ids = np.array(plain.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        mine = {(s, m) for n, s, m, _ in got[r.doc_id] if n == len(ids)}
        for s, m in mine:
            want[r.doc_id].append((len(ids), s, m, zlib.crc32(ids[s : s + m].tobytes())))
    assert all(set(v) == set(want[k]) for k, v in got.items()) and set(got) == set(want)
    if source is documents:
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
        assert all(sum(m for _, _, m, _ in v) == v[0][0] for v in got.values())
    assert packing.pack(docs.limit(0), file).count() == 0


def test_pieces_of_odd_texts_have_the_tokenizers_ids():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(catalog.tokenizer_file())
    texts = ["", "a  b\u00a0c \u3000 d e\u0301 don't <|endoftext|>x Σ ΑΣ I\u0307 \x1c y\x85z  ﬁ 123 !!??", "  ", "x" * 5000, "don'T, a.b", "<|ENDOFTEXT|>", "x<\u0338y a,\u0301", "İstanbul, ŞİŞ", "e \u0301a\u200b b", "it's we'll\u2028he'S", None, "a.'s (b)c-d</b>'d|e"]
    ids, cuts = packing.text_ids(pa.array(texts), packing.PieceIds(plain))
    for i, t in enumerate(texts):
        assert ids[cuts[i] : cuts[i + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids + [1]


def test_pipeline_stages(spark, tmp_path):
    docs = documents(spark)
    for i, (_, work) in enumerate(corpus_pipeline.STAGES):
        out = work(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert after.columns == docs.columns and {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
            docs = after
    assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    assert corpus_pipeline.run(spark, DATA).count() == after.count()


def test_pipeline_on_awkward_and_empty_rows(spark):
    for docs in (awkward(spark), awkward(spark).limit(0)):
        for _, work in corpus_pipeline.STAGES[:-1]:
            assert work(spark, docs, DATA).columns == docs.columns
            docs = work(spark, docs, DATA)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() >= 0


def test_components_write_only_labels(spark, monkeypatch):
    """The stored links are read as they are, repeated or not: each further table costs a write per round."""
    written, plain = [], neardup.stage
    monkeypatch.setattr(neardup, "stage", lambda df, name: written.append(name) or plain(df, name))
    links = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (2, 3), (7, 9)], "a bigint, b bigint")
    got = {r.node: r.label for r in neardup.components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 9: 7}
    assert set(written) == {"labels"}


@pytest.fixture
def small_skew(spark):
    """Shuffles of 16 partitions as they are, with skewed joins split by 16 kB."""
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_blocks_of_a_bucket_are_met_without_splitting(spark, monkeypatch, small_skew):
    """A large bucket's members go as one row per block: the join with representatives takes a task per partition, not one per pair of splits."""
    base = prose(5, 200).split()
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" if (j * 7 + i) % 40 == 0 else w for j, w in enumerate(base))) for i in range(700)], "doc_id bigint, text string")
    plain, most, tracker = neardup.stage, [], spark.sparkContext.statusTracker()

    def counted(df, name):
        spark.sparkContext.setJobGroup(f"{name}-{len(most)}", name)
        out = plain(df, name)
        if name == "pairs":
            stages = {s for j in tracker.getJobIdsForGroup(f"{name}-{len(most)}") for s in tracker.getJobInfo(j).stageIds}
            most.append(max(i.numTasks for s in stages if (i := tracker.getStageInfo(s))))
        return out

    monkeypatch.setattr(neardup, "stage", counted)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert len(got) == 700 and len(most) > 1 and max(most[1:]) <= 16


def test_verified_pairs_keep_their_columns(spark):
    sets = spark.createDataFrame([(1, [1, 2, 3, 4, 5], [1] * 5), (2, [1, 2, 3, 4, 5, 6], [1] * 6), (3, [9], [1])], "node bigint, keys array<bigint>, counts array<int>")
    pairs = spark.createDataFrame([(1, 2, 10, 20), (1, 3, 10, 30)], "a bigint, b bigint, la bigint, lb bigint")
    assert [tuple(r) for r in neardup.verified(pairs, sets, 0.8, "set").collect()] == [(1, 2, 10, 20)]
