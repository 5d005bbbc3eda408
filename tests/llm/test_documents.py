"""Operators on documents against brute force, on a table of awkward rows and on an empty one."""

import hashlib
import random

import helpers as H
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from terrapanel.llm import anchors, jaccard, lines, packing, token_counts, token_store, winnowing
from terrapanel.session import checkpointed, scratch_path

PLAIN = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def collected(df, *columns):
    return H.multiset(tuple(r) for r in df.select(*columns).collect())


def test_substring_dedup(awkward, nothing):
    rows, _, docs = awkward
    assert collected(anchors.remove_repeats(docs), "doc_id", "n_words", "n_removed", "text") == H.multiset(H.substring(rows))
    assert anchors.remove_repeats(nothing).count() == 0


def test_cover_meets_every_pair_of_places():
    for window in (2, 3, 5, 13, 14, 30):
        period, cover = anchors.cover_for(window)
        for i in range(period):
            for j in range(period):
                assert any((i + d) % period in cover and (j + d) % period in cover for d in range(period))


def test_contamination(awkward, nothing, spark):
    rows, items, docs = awkward
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = winnowing.contamination(docs, bench).withColumn("joined", F.array_join("items", ","))
    assert collected(got, "doc_id", "n_words", "n_hit", "n_items", "joined") == H.multiset(H.contamination(rows, items))
    assert winnowing.contamination(nothing, bench).count() == 0
    clean = winnowing.contamination(docs, bench.limit(0))
    assert clean.filter("n_hit > 0 OR n_items > 0").count() == 0 and clean.count() == len(rows)


def test_decontaminate_keeps_rows_as_they_are(awkward, spark):
    rows, items, docs = awkward
    kept = winnowing.decontaminate(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    assert kept.schema == docs.schema
    facts = H.contamination(rows, items)
    expected = [r for r, f in zip(rows, facts) if not (f[2] and 20 * f[2] >= f[1])]
    assert H.multiset(kept.collect()) == H.multiset(expected) and len(expected) < len(rows)


@pytest.mark.parametrize("tile", [512, 2])
def test_links(awkward, nothing, tile):
    rows, _, docs = awkward
    got = jaccard.link(docs, tile=tile)
    assert collected(got, "doc_id", "class_id", "n_links") == H.multiset(H.links(rows)[0])
    if tile == 512:
        assert jaccard.link(nothing).count() == 0


def test_rows_without_id_meet_only_their_like(spark):
    """Thousands of different texts of null id, in time as if they had ids, with some copies among them."""
    words = [" ".join(f"w{(i * 31 + j * j * 7) % 9973}" for j in range(40)) for i in range(5000)]
    rows = [(None, t) for t in words] + [(None, t) for t in words[:50]] + [(7, words[3]), (8, words[60] + " more")]
    got = jaccard.link(spark.createDataFrame(rows, "doc_id int, text string").repartition(6)).select("doc_id", "class_id", "n_links").collect()
    assert len(got) == len(rows) and sum(r.n_links > 0 for r in got) == 2 * 50 + 1 + 2
    assert sorted(r.class_id for r in got if r.class_id is not None) == [7, 7, 7, 8, 8]


def test_keep_one_of_each_class(awkward):
    rows, _, docs = awkward
    kept = jaccard.keep_one(docs)
    assert kept.schema == docs.schema
    got = [tuple(r) for r in kept.collect()]
    _, parts, sets = H.links(rows)
    group = {}
    for r, p, s in zip(rows, parts, sets):
        group.setdefault(r[:2], set()).add(p if s else None)
    left = [p for r in got for p in group[r[:2]] if p is not None]
    assert len(left) == len(set(left)) == len({p for p, s in zip(parts, sets) if s})
    assert sum(None in group[r[:2]] for r in got) == sum(not s for s in sets)


def test_band_count_reaches_the_recall():
    for threshold, recall, rows in ((0.8, 0.9999, 6), (0.5, 0.99, 3), (0.9, 0.999, 10)):
        n = jaccard.band_count(threshold, recall, rows)
        assert 1 - (1 - threshold**rows) ** n >= recall > 1 - (1 - threshold**rows) ** (n - 1)


def test_line_dedup(awkward, nothing):
    rows, _, docs = awkward
    got = lines.remove_repeated_lines(docs)
    expected = H.lines_left(rows)
    assert collected(got, "doc_id", "text", "n_lines", "n_removed") == H.multiset(expected)
    assert sum(e[3] for e in expected) > 0
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert lines.remove_repeated_lines(docs, counts=False).schema.names == docs.columns
    assert lines.remove_repeated_lines(nothing).count() == 0


def test_moved_lines_are_found(spark):
    passage = [f"line {i} of a passage" for i in range(30)]
    rows = [(1, "\n".join(passage)), (2, "\n".join(["new start", "and more", *passage]))]
    got = {r.doc_id: r for r in lines.remove_repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed >= 20


def whole_runs_left(rows):
    """Brute force without cuts or hashes: pairs of lines, where blank lines may lie between, that occur before."""
    first, found = {}, []
    for doc_id, text in sorted(rows):
        lines_ = text.split("\n")
        full = [i for i, x in enumerate(lines_) if x.strip(" ")]
        gone = set()
        for a, b in zip(full, full[1:]):
            at = first.setdefault(tuple(lines_[a : b + 1]), (doc_id, a))
            if at[0] != doc_id or a >= at[1] + b - a + 1:
                gone.update(range(a, b + 1))
        found.append((doc_id, [x for i, x in enumerate(lines_) if i not in gone]))
    return found


def test_short_passages_between_unlike_lines_go_whole(spark):
    rnd, rows = random.Random(4), []
    passages = [[f"passage {p} line {i}" for i in range(2 + p % 9)] for p in range(45)]
    for d in range(3):
        for p, passage in enumerate(passages):
            own = [f"own {d} {p} {i}" for i in range(rnd.randint(1, 4))]
            cut = passage[: len(passage) // 2 + 1] + ["", ""] + passage[len(passage) // 2 + 1 :] if p % 3 == 0 else passage
            rows.append((d * 1000 + p, "\n".join([*own, *cut, f"end {d} {p}"])))
    rows += [(9000, "\n".join(["round"] * 7)), (9001, "a\nb\na\nb\na"), (9002, "one line"), (9003, ""), (9004, " \n\n ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    full = lambda text: [x for x in text.split("\n") if x.strip(" ")]  # noqa: E731  chunks may take the blank lines at their ends along
    got = {r.doc_id: full(r.text) for r in lines.remove_repeated_lines(docs, whole=True).collect()}
    assert got == {d: full("\n".join(left)) for d, left in whole_runs_left(rows)}
    assert all(len(got[d * 1000 + p]) == len([x for x in got[d * 1000 + p] if x.startswith(("own", "end"))]) for d in (1, 2) for p in range(45))
    by_cuts = {r.doc_id: full(r.text) for r in lines.remove_repeated_lines(docs).collect()}
    assert sum(map(len, got.values())) < sum(map(len, by_cuts.values()))


def test_copies_of_one_id_keep_one_occurrence(spark):
    rows = [(None, f"shared one\nshared two\nown {i}") for i in range(3)] + [(5, "x y\ny z\nleft"), (5, "x y\ny z\nright")]
    got = [r.text for r in lines.remove_repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), whole=True).collect()]
    assert sum("shared one" in t for t in got) == 1 and sum("x y" in t for t in got) == 1 and len(got) == 5


def test_packing(awkward, nothing):
    rows, _, docs = awkward
    got = packing.pack(checkpointed(packing.token_pieces(docs, with_ids=True))).collect()
    expected = []
    for r in rows:
        ids = [*ids_of(r[1]), 1]
        expected += [(r[0], i, s, len(ids[s : s + 4096]), H.crc(ids[s : s + 4096])) for i, s in enumerate(range(0, len(ids), 4096))]
    assert H.multiset((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == H.multiset(expected)
    sequences = {}
    for r in got:
        assert H.crc([int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)]) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(sequences) <= -(-sum(e[3] for e in expected) // 4096) + 1
    assert packing.pack_documents(nothing).count() == 0


def test_token_store(awkward, nothing, spark):
    rows, _, docs = awkward
    path = scratch_path(spark)
    token_store.write_store(docs, path)
    got = sorted(token_store.read_store(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    found = H.multiset((r.doc_id, r.n_tokens, bytes(r.ids)) for r in got)
    expected = [(r[0], [*ids_of(r[1]), 1]) for r in rows]
    assert found == H.multiset((d, len(ids), b"".join(i.to_bytes(4, "little") for i in ids)) for d, ids in expected)
    path = scratch_path(spark)
    token_store.write_store(nothing, path)
    assert token_store.read_store(spark, path).count() == 0


def test_token_counts_follow_edits(awkward, nothing, spark):
    rows, _, docs = awkward
    edits = [r for r in token_counts.example_edits(docs).distinct().collect()]
    more = [(0, 9, -5, 10_000_000, ""), (0, 10, 7, 0, "new text\nwith <|endoftext|> in it"), (1, 9, 10_000, 5, "end"),
            (2, None, None, None, None), (None, 1, 0, 5, "never"), (10_000, 1, 0, 5, "never"), (3, 9, 2, 1, "word " * 900), (3, 10, 2, 3000, "")]
    table = spark.createDataFrame([tuple(e) for e in edits] + more, "doc_id bigint, seq int, start bigint, removed int, inserted string")
    by_id = {}
    for d, *e in [tuple(e) for e in edits] + more:
        if d is not None:
            by_id.setdefault(d, []).append((e[0] or 0, e[1] or 0, e[2] or 0, e[3] or ""))
    expected = []
    for r in rows:
        text = r[1] or ""
        for _, start, removed, inserted in sorted(by_id.get(r[0], [])):
            start = min(max(start, 0), len(text))
            text = text[:start] + inserted + text[start + max(removed, 0) :]
        expected.append((r[0], len(ids_of(r[1])), len(ids_of(text)), len(by_id.get(r[0], [])), text))
    got = token_counts.counts_after_edits(docs, table)
    assert collected(got, "doc_id", "n_before", "n_tokens", "n_edits", "text") == H.multiset(expected)
    again = got.select(F.aggregate("tokens", F.lit(0), lambda a, x: a + x).alias("sum"), "n_tokens", F.length("text").alias("n"),
                       F.aggregate("chars", F.lit(0), lambda a, x: a + x).alias("c"))
    assert again.filter("sum != n_tokens OR n != c").count() == 0
    assert token_counts.counts_after_edits(nothing, table).count() == 0


def test_only_edited_stretches_are_encoded(spark):
    text = "some words of a long text " * 4000
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    edits = spark.createDataFrame([(1, 1, 50_003, 4, "other")], "doc_id bigint, seq int, start int, removed int, inserted string")
    r = token_counts.counts_after_edits(docs, edits).first()
    assert r.chars_encoded < 3 * token_counts.STRETCH < len(text) / 100


def test_pipeline_stages(awkward, nothing, spark, tmp_path):
    rows, items, docs = awkward
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = checkpointed(stage(spark, left, str(tmp_path)))
        assert left.schema.names == docs.schema.names, name
    # the same by brute force: without labels nothing is toxic
    now = [(d, t) for d, t, *_ in H.lines_left(rows)]
    _, parts, sets = H.links(now)
    order = sorted(range(len(now)), key=lambda i: (now[i][0] is None, now[i][0] or 0))
    seen, kept = set(), []
    for i in order:
        if not sets[i] or parts[i] not in seen:
            seen.add(parts[i])
            kept.append(now[i])
    facts = H.contamination(kept, items)
    expected = {d for (d, _), f in zip(kept, facts) if not (f[2] and 20 * f[2] >= f[1]) and d is not None}
    assert {r.doc_id for r in left.select("doc_id").collect()} - {None} == expected
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == left.select("doc_id").distinct().count()
    empty = nothing
    for name, stage in corpus_pipeline.STAGES:
        empty = checkpointed(stage(spark, empty, str(tmp_path)))
        assert empty.count() == 0, name


def test_sha_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
