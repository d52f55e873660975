"""Vocabulary build, order-free sign lookup, sentence decomposition, unknown profiling.

Scale notes
* Entry word lists are never collected into one row: per key we aggregate to distinct
  (word, count, first position) rows and keep the best two per key with a ranked window
  whose ``<= 2`` filter becomes a partial ``WindowGroupLimit`` before the shuffle (a hot
  key costs its reducer two rows per map task).
* The vocabulary join is broadcast only behind a check of its bytes; otherwise it is a
  shuffle join on the key, where AQE splits hot keys (e.g. punctuation signs).
* Sentence re-grouping collects one sentence's signs, bounded by the sentence length.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fsw as fx
from ..functions.text import SIGN_GLUE, SYNONYM_SEP, UNIT_GLUE, UNKNOWN, first_two_distinct, lower_strip
from ..functions.text import top_two_counted as top_two_counted_list
from ..session import checked_broadcast, checkpoint
from .indexing import dense_index

# Lookup tables up to this size, measured, are broadcast; larger ones are joined by a shuffle.
VOCAB_BROADCAST_BYTES = 64 * 1024 * 1024

# Rows in a chunk of an entry's lists, at most.
CHUNK_ROWS = 256


def _ordered_join(items: Column, field: str, glue: str) -> Column:
    """Join ``field`` of an array of structs that sorts by its first field."""
    return F.array_join(F.transform(F.array_sort(items), lambda s: s[field]), glue)


def _top_two(counted: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """Per key, the two first ``_w`` values in ``order`` joined with ``|``.

    The ``row_number() <= 2`` filter makes Spark plan a partial ``WindowGroupLimit``
    before the shuffle: every map task sends at most two rows per key, so a hot key
    costs its reducer two rows per map task, never the whole group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    top = counted.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    return top.groupBy(*keys).agg(_ordered_join(F.collect_list(F.struct("_r", "_w")), "_w", SYNONYM_SEP).alias(name))


def top_two_counted(df: DataFrame, group_cols: list[str], word_col: str, order_col: str,
                    name: str = "canonical") -> DataFrame:
    """Per group: lower+strip the words, count them, keep the two most frequent (ties:
    first seen), join with ``|``. ``order_col`` gives the first-seen order."""
    norm = df.select(*group_cols, lower_strip(F.col(word_col)).alias("_w"), F.col(order_col).alias("_o"))
    counted = norm.groupBy(*group_cols, "_w").agg(F.count(F.lit(1)).alias("_n"), F.min("_o").alias("_first"))
    return _top_two(counted, group_cols, [F.desc("_n"), F.asc("_first")], name)


def first_two_distinct_grouped(df: DataFrame, group_cols: list[str], word_col: str, order_col: str,
                               name: str = "canonical_first2") -> DataFrame:
    """Per group: the first two distinct lower+stripped words in ``order_col`` order."""
    norm = df.select(*group_cols, lower_strip(F.col(word_col)).alias("_w"), F.col(order_col).alias("_o"))
    firsts = norm.groupBy(*group_cols, "_w").agg(F.min("_o").alias("_first"))
    return _top_two(firsts, group_cols, [F.asc("_first")], name)


def most_frequent(df: DataFrame, group_cols: list[str], value_col: str, order_col: str,
                  name: str) -> DataFrame:
    """Per group: the most frequent value, ties to the first seen (no window needed)."""
    counted = df.groupBy(*group_cols, value_col).agg(
        F.count(F.lit(1)).alias("_n"), F.min(order_col).alias("_first"))
    best = counted.groupBy(*group_cols).agg(
        F.min(F.struct((-F.col("_n")).alias("n"), F.col("_first").alias("f"), F.col(value_col).alias("v")))
        .alias("_best"))
    return best.select(*group_cols, F.col("_best.v").alias(name))


def dedupe_first(df: DataFrame, cols: list[str], order_col: str, count: str | None = None) -> DataFrame:
    """Distinct rows on ``cols``, keeping the first ``order_col`` of each; ``count`` names a column
    for the number of copies."""
    copies = [F.count(F.lit(1)).alias(count)] if count else []
    return df.groupBy(*cols).agg(F.min(order_col).alias(order_col), *copies)


def vocabulary_words(corpus: DataFrame, order_col: str = "p_partkey", word_col: str = "word",
                     fsw_col: str = "fsw") -> DataFrame:
    """Long form of the entry word lists: (symbol, order, wpos, word) per synonym.

    ``word`` holds ``a|b`` synonyms; ``order``/``wpos`` keep corpus order."""
    rows = dedupe_first(corpus.select(order_col, word_col, fsw_col), [word_col, fsw_col], order_col)
    keyed = rows.select(fx.symbol_key(F.col(fsw_col)).alias("symbol"), F.col(order_col).alias("order"),
                        F.col(fsw_col).alias("fsw"), F.col(word_col).alias("_word"))
    return keyed.select("symbol", "order", "fsw",
                        F.posexplode(F.split(F.col("_word"), r"\|")).alias("wpos", "word"))


def build_vocabulary(corpus: DataFrame, order_col: str = "p_partkey", word_col: str = "word",
                     fsw_col: str = "fsw") -> DataFrame:
    """Group corpus rows by their order-free symbol key.

    Returns ``id`` (0-based, key order), ``symbol`` (key), ``canonical`` (two most frequent
    words, counted), ``canonical_first2`` (first two distinct words), ``fsw`` (most frequent
    sign, first seen on ties), ``n_rows`` and ``n_words``.

    (key, word) -> count and first position, then the two best words per key by
    (count desc, first) and by (first) with group-limited windows; (key, sign) -> sign
    mode (a ``min(struct)`` aggregate) and row count.
    """
    words = vocabulary_words(corpus, order_col, word_col, fsw_col)
    entries, counted = _entry_aggregates(words.withColumn("order", F.struct("order", "wpos")), ["symbol"],
                                         words.where("wpos = 0").select("symbol", "fsw", "order"))
    out = dense_index(entries, ["symbol"], "id").select(*ENTRY_COLUMNS)
    counted.unpersist()
    return out


ENTRY_COLUMNS = ["id", "symbol", "canonical", "canonical_first2", "fsw", "n_rows", "n_words"]


def _entry_aggregates(words: DataFrame, keys: list[str], signs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of ``keys`` from their words (``word``, ``order``) and signs (``fsw``, ``order``), without a list of
    either; also the counts that were persisted for it, to be freed when the entries are written."""
    norm = words.select(*keys, lower_strip(F.col("word")).alias("_w"), F.col("order").alias("_o"))
    counted = norm.groupBy(*keys, "_w").agg(F.count(F.lit(1)).alias("_n"), F.min("_o").alias("_first"))
    # four consumers below, which the caller writes in one go
    counted = counted.persist(StorageLevel.MEMORY_AND_DISK)
    canon = _top_two(counted, keys, [F.desc("_n"), F.asc("_first")], "canonical")
    first2 = _top_two(counted, keys, [F.asc("_first")], "canonical_first2")
    n_words = counted.groupBy(*keys).agg(F.sum("_n").alias("n_words"))
    modes = signs.groupBy(*keys, "fsw").agg(F.count(F.lit(1)).alias("_n"), F.min("order").alias("_first"))
    mode = modes.groupBy(*keys).agg(
        F.min(F.struct((-F.col("_n")).alias("n"), F.col("_first").alias("f"), F.col("fsw").alias("v")))
        .getField("v").alias("fsw"),
        F.sum("_n").alias("n_rows"))
    return canon.join(first2, keys).join(n_words, keys).join(mode, keys), counted


def entry_chunks(corpus: DataFrame, order_col: str = "p_partkey", word_col: str = "word",
                 fsw_col: str = "fsw", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The lists of all words and signs of each entry, in chunks that are bounded however often its key occurs.

    Returns ``id`` (as in ``build_vocabulary``), ``symbol``, ``chunk`` (from 0), ``first`` (number of the entry's rows
    before this chunk), ``word`` and ``fsw`` (lists in corpus order). Chunks are cut where the number of the
    row in (key, corpus order) divides by ``chunk_rows``, so an entry's first and last chunk may be short. Distinct
    (word, sign) rows count once; rows without word or sign make no entry.

    Rows are numbered over ranges that split a hot key, and grouped by (key, block): no task and no row holds a
    key's lists. Only blocks' first numbers, one a chunk, meet by key alone."""
    rows = dedupe_first(corpus.select(order_col, word_col, fsw_col), [word_col, fsw_col], order_col)
    rows = rows.select(fx.symbol_key(F.col(fsw_col)).alias("symbol"), F.col(order_col).alias("order"),
                       F.split(F.col(word_col), r"\|").alias("words"), F.col(fsw_col).alias("sign"))
    rows = rows.where(F.col("symbol").isNotNull() & F.col("words").isNotNull())
    rows = dense_index(rows, ["symbol", "order", "words", "sign"], "_pos")
    rows = rows.withColumn("_block", F.expr(f"_pos div {int(chunk_rows)}"))
    blocks = rows.groupBy("symbol", "_block").agg(F.min("_pos").alias("_first"))
    starts = dense_index(blocks.groupBy("symbol").agg(F.min("_first").alias("_start")), ["symbol"], "id")
    places = blocks.join(starts, "symbol").select(
        "symbol", "_block", "id", (F.col("_block") - F.expr(f"_start div {int(chunk_rows)}")).alias("chunk"),
        (F.col("_first") - F.col("_start")).alias("first"))
    items = F.array_sort(F.collect_list(F.struct("_pos", "words", "sign")))  # at most chunk_rows
    lists = rows.groupBy("symbol", "_block").agg(items.alias("_i"))
    return lists.join(places, ["symbol", "_block"]).select(
        "id", "symbol", "chunk", "first", F.flatten(F.transform("_i", lambda x: x["words"])).alias("word"),
        F.transform("_i", lambda x: x["sign"]).alias("fsw"))


def vocabulary_of_chunks(chunks: DataFrame) -> DataFrame:
    """``entry_chunks``, stored or not -> the rows of ``build_vocabulary``, without joining any chunks."""
    place = lambda values, name: chunks.select("id", "symbol", "chunk", F.posexplode(values).alias("pos", name)) \
        .select("id", "symbol", name, F.struct("chunk", "pos").alias("order"))
    entries, counted = _entry_aggregates(place("word", "word"), ["id", "symbol"], place("fsw", "fsw"))
    out = checkpoint(entries.select(*ENTRY_COLUMNS))
    counted.unpersist()
    return out


def lists_of_chunks(chunks: DataFrame) -> DataFrame:
    """The stored form of the vocabulary from its chunks: one row an entry (``id``, ``symbol``, ``word``, ``fsw``).

    An entry's lists are one row by that format, so this belongs right before a sink; jobs read the chunks or the
    long form (``vocabulary_words``)."""
    items = F.array_sort(F.collect_list(F.struct("chunk", "word", "fsw")))
    return chunks.groupBy("id", "symbol").agg(items.alias("_i")).select(
        "id", "symbol", F.flatten(F.transform("_i", lambda x: x["word"])).alias("word"),
        F.flatten(F.transform("_i", lambda x: x["fsw"])).alias("fsw"))


def entry_lists(corpus: DataFrame, order_col: str = "p_partkey", word_col: str = "word",
                fsw_col: str = "fsw") -> DataFrame:
    """The stored form of the vocabulary: ``id`` (as in ``build_vocabulary``), ``symbol``, ``word`` and
    ``fsw``, the lists of all words and signs of the entry in corpus order (see ``lists_of_chunks``)."""
    return lists_of_chunks(entry_chunks(corpus, order_col, word_col, fsw_col))


def parse_sign_rows(signs: DataFrame, fsw_col: str = "fsw") -> DataFrame:
    """Add ``symbol`` (symbols in written order) and ``key`` (sorted) for one-sign rows."""
    # the ids are one column of their own, so that a sign is matched once for both outputs
    ids = F.transform(F.regexp_extract_all(F.col(fsw_col), F.lit(fx.SYMBOL_WITH_COORDS), 0), lambda t: F.substring(t, 1, 6))
    return signs.withColumn("_ids", ids).withColumn("symbol", F.array_join("_ids", " ")) \
                .withColumn("key", F.array_join(F.array_sort("_ids"), " ")).drop("_ids")


def explode_sequences(seqs: DataFrame, id_col: str = "sentence_id", fsw_col: str = "fsw") -> DataFrame:
    """Sentence rows with a whitespace-separated sign sequence -> one row per sign."""
    return seqs.select(id_col, F.posexplode(fx.split_signs(F.col(fsw_col))).alias("pos", "fsw")) \
               .withColumn("pos", F.col("pos").cast("bigint"))


def lookup_signs(signs: DataFrame, vocab: DataFrame, fsw_col: str = "fsw",
                 broadcast_bytes: int = VOCAB_BROADCAST_BYTES) -> DataFrame:
    """Left lookup of each sign's key in the vocabulary: adds ``symbol``, ``key``, ``word``
    (canonical, or ``<unk>`` when no entry has the same symbol multiset).

    Entries that share a key (appended unknowns of another symbol order) are one match: their
    words are pooled in id order, as the last of one and the first of the next joined by a space,
    and the first entry gives the id. No sign ever matches twice."""
    lex = lexicon(vocab)
    lex = checked_broadcast(lex, broadcast_bytes, 64 + F.length("key") + F.length("_canon"))
    return _look_up(parse_sign_rows(signs, fsw_col), lex)


def lexicon(vocab: DataFrame) -> DataFrame:
    """One row per key of the vocabulary: ``key``, the pooled words ``_canon`` and the first ``entry_id``."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("id").alias("id"), F.col("canonical").alias("canon"))))
    lex = vocab.groupBy(F.col("symbol").alias("key")).agg(entries.alias("_e"))
    pooled = top_two_counted_list(F.split(F.array_join(F.transform(
        "_e", lambda e: F.replace(e["canon"], F.lit(SYNONYM_SEP), F.lit(", "))), " "), ","))
    return lex.select("key", F.when(F.size("_e") == 1, F.col("_e")[0]["canon"]).otherwise(pooled).alias("_canon"),
                      F.col("_e")[0]["id"].alias("entry_id"))


def _look_up(keyed: DataFrame, lex: DataFrame) -> DataFrame:
    out = keyed.join(lex, "key", "left")
    return out.withColumn("word", F.coalesce(F.col("_canon"), F.lit(UNKNOWN))).drop("_canon")


def write_lexicon(vocab: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Store ``lexicon(vocab)`` as a table in ``buckets`` buckets by key, for lookups beyond the broadcast bound:
    keys are shuffled here, once, not in every lookup. ``path`` places the files outside the warehouse."""
    writer = lexicon(vocab).repartition(buckets, "key").write.mode("overwrite").bucketBy(buckets, "key").sortBy("key")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def write_keyed_signs(signs: DataFrame, table: str, buckets: int, path: str | None = None, fsw_col: str = "fsw") -> None:
    """Store parsed signs in buckets by key; with as many buckets as the lexicon, a lookup shuffles nothing."""
    keyed = parse_sign_rows(signs, fsw_col)
    writer = keyed.repartition(buckets, "key").write.mode("overwrite").bucketBy(buckets, "key").sortBy("key")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def lookup_signs_bucketed(signs: DataFrame, table: str, fsw_col: str = "fsw") -> DataFrame:
    """``lookup_signs`` in a table of ``write_lexicon``; its side of the join is read by buckets, without an
    exchange. ``signs`` are sign rows, or rows of a table of ``write_keyed_signs``."""
    keyed = signs if {"symbol", "key"} <= set(signs.columns) else parse_sign_rows(signs, fsw_col)
    return _look_up(keyed, signs.sparkSession.table(table))


def regroup_sentences(units: DataFrame, id_col: str = "sentence_id") -> DataFrame:
    """Re-group sign rows into one row per sentence, in sign order: ``fsw`` joined by
    spaces, ``symbol`` by `` | ``, ``word`` by `` # ``."""
    items = F.array_sort(F.collect_list(F.struct("pos", "fsw", "symbol", "word")))
    g = units.groupBy(id_col).agg(items.alias("_items"))
    return g.select(
        id_col,
        F.array_join(F.transform("_items", lambda s: s["fsw"]), " ").alias("fsw"),
        F.array_join(F.transform("_items", lambda s: s["symbol"]), SIGN_GLUE).alias("symbol"),
        F.array_join(F.transform("_items", lambda s: s["word"]), UNIT_GLUE).alias("word"),
        F.size("_items").cast("bigint").alias("n_signs"),
        F.size(F.filter("_items", lambda s: s["word"] == UNKNOWN)).cast("bigint").alias("n_unk"),
    )


def decompose_sentences(signs: DataFrame, vocab: DataFrame, id_col: str = "sentence_id") -> DataFrame:
    """Sign rows -> decomposed sentences (units per sign, ``<unk>`` where missing)."""
    return regroup_sentences(lookup_signs(signs, vocab), id_col)


def drop_unknown_sentences(decomposed: DataFrame, col: str = "word") -> DataFrame:
    """The "filtered" training set: sentences without any unknown unit."""
    return decomposed.where(~F.col(col).contains(UNKNOWN))


def unknown_frequency(units: DataFrame) -> DataFrame:
    """Count unknown signs by their written symbol string, most frequent first."""
    return units.where(F.col("word") == UNKNOWN).groupBy("symbol") \
                .agg(F.count(F.lit(1)).alias("cnt"))


def top_unknown_labels(units: DataFrame, top_n: int) -> DataFrame:
    """The ``top_n`` most frequent unknown symbols named ``unk_1``… (ties: symbol order)."""
    freq = unknown_frequency(units)
    top = freq.orderBy(F.desc("cnt"), F.asc("symbol")).limit(top_n)
    w = Window.orderBy(F.desc("cnt"), F.asc("symbol"))  # at most top_n rows
    return top.withColumn("rank", F.row_number().over(w).cast("bigint")) \
              .withColumn("label", F.concat(F.lit("unk_"), F.col("rank").cast("string")))


def label_unknowns(units: DataFrame, top_n: int) -> DataFrame:
    """Replace the unit of the ``top_n`` most frequent unknown symbols by their label. The units are
    written once and read twice: to count and to label."""
    units = checkpoint(units)
    labels = top_unknown_labels(units, top_n).select("symbol", "label")
    out = units.join(F.broadcast(labels), "symbol", "left")  # top_n rows
    return out.withColumn("word", F.coalesce(F.col("label"), F.col("word"))).drop("label")


def append_unknown_entries(vocab: DataFrame, units: DataFrame, top_n: int) -> DataFrame:
    """Vocabulary plus one entry per top unknown symbol, ids continuing after max(id).

    The new entry is keyed by the sorted symbols (so the lookup finds it), its word is
    the label and its sign a pseudo sign built from the written symbols.
    """
    labels = top_unknown_labels(units, top_n)
    max_id = vocab.select(F.coalesce(F.max("id"), F.lit(-1))).scalar()  # scalar subquery
    sorted_key = F.array_join(F.array_sort(F.split(F.col("symbol"), " ")), " ")
    new = labels.select(
        (max_id + F.col("rank")).cast("bigint").alias("id"),
        sorted_key.alias("symbol"),
        F.col("label").alias("canonical"),
        F.col("label").alias("canonical_first2"),
        fx.symbol_to_pseudo_fsw(F.col("symbol")).alias("fsw"),
        F.lit(1).cast("bigint").alias("n_rows"),
        F.lit(1).cast("bigint").alias("n_words"),
    )
    return vocab.unionByName(new)


def map_signs_to_units(seqs: DataFrame, vocab: DataFrame, id_col: str = "seq_id",
                       fsw_col: str = "fsw") -> DataFrame:
    """Many sign sequences at once -> `` # ``-joined units (sign -> text direction)."""
    units = lookup_signs(explode_sequences(seqs, id_col, fsw_col), vocab)
    return regroup_sentences(units, id_col).select(id_col, F.col("word").alias("units"))


def union_with_vocabulary(train: DataFrame, corpus: DataFrame) -> DataFrame:
    """Training sentences plus the vocabulary rows (word as sentence), train only."""
    a = train.select(F.col("sentence").cast("string"), F.col("fsw"), F.lit("train").alias("origin"))
    b = corpus.select(F.col("word").alias("sentence"), F.col("fsw"), F.lit("vocabulary").alias("origin"))
    return a.unionByName(b)


def lexicon_from_entries(entries: DataFrame) -> DataFrame:
    """Lookup table from stored vocabulary entries (``id``, ``symbol``, ``word`` list).

    ``symbol`` may be one key or a list of keys; every key of every entry is matched. Entries in chunks
    (``entry_chunks``) are read as they are.
    When several entries share a key, their word lists are pooled (entry order, then
    word order) before the two most frequent words are taken. Returns
    ``symbol``, ``canonical``, ``id`` (the first entry of the key)."""
    sym_type = entries.schema["symbol"].dataType
    keys = F.explode("symbol") if isinstance(sym_type, T.ArrayType) else F.col("symbol")
    chunk = F.col("chunk") if "chunk" in entries.columns else F.lit(0)
    e = entries.select("id", chunk.alias("chunk"), keys.alias("symbol"), "word")
    w = e.select("symbol", "id", "chunk", F.posexplode("word").alias("wpos", "w")) \
         .withColumn("_o", F.struct("id", "chunk", "wpos"))
    canon = top_two_counted(w, ["symbol"], "w", "_o", "canonical")
    ids = e.groupBy("symbol").agg(F.min("id").alias("id"))
    return canon.join(ids, "symbol")


def entries_with_canonical(entries: DataFrame) -> DataFrame:
    """Stored entries -> add per-entry ``canonical_first2`` (first two distinct words) and
    ``fsw`` as the entry's most frequent sign (row expressions over the entry's lists)."""
    from .retrieval import mode_of_list
    return entries.withColumn("canonical_first2", first_two_distinct(F.col("word"))) \
                  .withColumn("fsw", F.when(F.col("fsw").isNull(), F.lit(None))
                              .otherwise(mode_of_list(F.col("fsw"))))
