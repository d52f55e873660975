"""Registered queries that write a sink's files and read them back with the matching source; the
oracle SQL says which rows must come back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import metrics as mt
from ..operators import vocab as vc
from ..session import default_parallelism, ensure_checkpoint_dir
from ..sinks import writers as wr
from ..sources import files as fs
from ..sources.tables import corpus_view, known_corpus_view, read_table, signs_view
from . import sqlparts as sq
from .job_queries import _ENTRIES
from .queries import _DOC_TOKENS, _consecutive_doc_metrics, register


def _folder(spark) -> str:
    """A fresh folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CONSTANTS = " union all ".join(f"select {_quoted(w)} word, {_quoted(f)} fsw" for w, f in wr.CORPUS_CONSTANT_LINES)


@register("written_pair_lines", sq.with_(sq.WHOLE_CORPUS) + f"select distinct word, fsw from (select word, fsw from corpus union all {_CONSTANTS})")
def q_written_pair_lines(spark, sf_dir):
    """K1, K2 -> S2: the sign corpus and its constants as ``left# right`` lines."""
    path = _folder(spark)
    wr.write_pair_text(wr.with_corpus_constants(corpus_view(spark, sf_dir)), path, "word", "fsw")
    return fs.read_pair_text(spark, path, "word", "fsw")[0].select("word", "fsw")


@register("written_csv", "select doc_id, nullif(lang, '') lang, nullif(text, '') text, n_chars from documents")
def q_written_csv(spark, sf_dir):
    """K3 -> S1: whole texts with quotes, commas, line ends and outer blanks; an empty field is null."""
    rows, path = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text", "n_chars"), _folder(spark)
    wr.write_csv(rows, path)
    return fs.read_csv(spark, path, rows.schema).drop("row_id")


@register("written_space_separated", sq.with_(sq.WHOLE_CORPUS) + "select p_partkey, word, fsw from corpus")
def q_written_space_separated(spark, sf_dir):
    """K7: no header, blanks between the fields, fields with blanks in quotes."""
    rows, path = corpus_view(spark, sf_dir).select("p_partkey", "word", "fsw"), _folder(spark)
    wr.write_csv(rows, path, header=False, sep=" ")
    return fs.read_csv(spark, path, rows.schema, header=False, sep=" ").drop("row_id")


@register("written_stage_json", sq.with_(sq.WHOLE_CORPUS, _ENTRIES) + "select id, symbol, words, signs from entries")
def q_written_stage_json(spark, sf_dir):
    """K4: vocabulary entries with their lists as JSON lines."""
    chunks, path = vc.entry_chunks(corpus_view(spark, sf_dir)), _folder(spark)
    wr.write_entries(chunks, path)
    back = spark.read.schema("id long, symbol string, word array<string>, fsw array<string>").json(path)
    return back.select("id", "symbol", F.array_join("word", "|").alias("words"), F.array_join("fsw", ", ").alias("signs"))


@register("written_entry_chunks", sq.with_(sq.WHOLE_CORPUS, sq.VOCAB) + "select * from vocab")
def q_written_entry_chunks(spark, sf_dir):
    """A2 -> K4 -> A6: the vocabulary out of stored chunks of its entries."""
    path = _folder(spark)
    wr.write_table(vc.entry_chunks(corpus_view(spark, sf_dir)), path)
    return vc.vocabulary_of_chunks(spark.read.parquet(path))


@register("lookup_bucketed", sq.with_(sq.SIGNS, sq.CORPUS, sq.VOCAB, sq.UNITS)
          + "select sentence_id, pos, key, symbol, word from units")
def q_lookup_bucketed(spark, sf_dir):
    """J2 beyond the broadcast bound: the lexicon as a table in buckets by key."""
    path, buckets = _folder(spark), default_parallelism(spark)
    table = "lexicon_" + path.rpartition("-")[2]
    vc.write_lexicon(vc.build_vocabulary(known_corpus_view(spark, sf_dir)), table, buckets, path)
    return vc.lookup_signs_bucketed(signs_view(spark, sf_dir), table).select("sentence_id", "pos", "key", "symbol", "word")


@register("written_aligned_lines", sq.with_(sq.WHOLE_CORPUS) + """
select row_number() over (order by p_partkey) - 1 row_id, word, fsw from corpus""")
def q_written_aligned_lines(spark, sf_dir):
    """K5 -> S4 -> J3: two text files, joined by the numbers of their lines."""
    rows, path = corpus_view(spark, sf_dir), _folder(spark)
    for column in ("word", "fsw"):
        wr.write_column_lines(rows, f"{path}/{column}", column, "p_partkey")
    word, sign = (fs.read_lines(spark, f"{path}/{column}", column) for column in ("word", "fsw"))
    return mt.align_by_position(word, sign).select("row_id", "word", "fsw")


@register("written_metric_report", "with " + _DOC_TOKENS + """
select doc_id + 1 "Row", printf('%.4f', round("precision", 4)) "Precision", printf('%.4f', round(recall, 4)) "Recall",
       printf('%.4f', round(f1, 4)) "F1" from f""")
def q_written_metric_report(spark, sf_dir):
    """K6: one line a row, four decimals."""
    rows, path = wr.metric_report(_consecutive_doc_metrics(spark, sf_dir), "doc_id"), _folder(spark)
    wr.write_csv(rows, path)
    return fs.read_csv(spark, path, rows.schema).drop("row_id")
