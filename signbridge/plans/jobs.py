"""Composite jobs (the public entry points), each a lazy DataFrame graph.

C1 prepare_corpus        C2 build_vocabulary (+ embeddings)   C3 decompose_sentences
C4 profile_unknowns      C5 build_training_sets               C6 retrieve_examples
C7 build_prompts         C8 ground_answers                    C9 map_signs_to_units
C10 join_gold            C11 evaluate_signs                   C12 evaluate_text
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fsw as fx
from ..functions import text as tx
from ..operators import attempts as at
from ..operators import embed as eb
from ..operators import embedding_store as es
from ..operators import indexing as ix
from ..operators import metrics as mt
from ..operators import prompts as pr
from ..operators import retrieval as rv
from ..operators import sampling as sm
from ..operators import vocab as vc
from ..session import checkpoint

KIND_SIGN = "Sign"
KIND_SENTENCE = "Sentence"


# ---- C1 --------------------------------------------------------------------------------------

def prepare_corpus(raw: DataFrame, kind: str = KIND_SIGN, spoken: str = "en", signed: str = "ase",
                   seed: int = sm.DEFAULT_SEED, reduce_sentences: bool = False) -> DataFrame:
    """Raw sign-bank rows -> ``(row_id, word, fsw[, sentence, split])``.

    Strip the key columns, drop rows missing any of them, keep one language pair and kind;
    signs keep all synonyms (``᛫`` -> ``|``), sentences their first text, unchanged, as
    ``sentence``. ``word`` is the two most frequent ``|`` parts, lower-cased: the form of the
    corpus file. Sentences get a seeded 95/2.5/2.5 split; with ``reduce_sentences`` their train
    rows are a sample of 5 % of the whole corpus, the other train rows go.
    """
    keys = ["spoken_language", "sign_language", "Sentence/Sign"]
    df = raw
    for c in keys:
        df = df.withColumn(c, tx.strip(c))
    df = df.dropna(subset=keys + ["annotated_texts_multilingual"])
    df = df.where((F.col("spoken_language") == spoken) & (F.col("sign_language") == signed)
                  & (F.col("Sentence/Sign") == kind))
    text = F.col("annotated_texts_multilingual")
    words = tx.replace_separator(text) if kind == KIND_SIGN else tx.first_segment(text)
    out = df.select("row_id", tx.top_two_counted(F.split(words, r"\|")).alias("word"),
                    F.col("sign_writing").alias("fsw"), words.alias("sentence"))
    if kind == KIND_SIGN:
        return out.drop("sentence")
    out = sm.split_train_dev_test(out, "row_id", seed=seed)
    if not reduce_sentences:
        return out
    out = checkpoint(out)  # counted, sampled and read once more: prepared once
    train = sm.sample_fraction(out.where("split = 'train'"), "row_id", seed=seed, base_total=out.count())
    return train.unionByName(out.where("split <> 'train'"))


# ---- C2 / C3 / C4 / C9 -------------------------------------------------------------------------

def _embedded(df: DataFrame, text_col: str, embed_fn, store: tuple[str, str] | None, dedupe: bool = True) -> DataFrame:
    if store is None:
        return eb.embed_column(df, text_col, embed_fn, "embedding", dedupe=dedupe)
    path, model = store
    return es.embed_stored(df, text_col, path, model, embed_fn)


def build_vocabulary(corpus: DataFrame, embed_fn=None, order_col: str = "row_id",
                     store: tuple[str, str] | None = None) -> DataFrame:
    """Vocabulary entries, with ``embed_fn`` an embedding of all the entry's words joined by ``|`` (one text, as models
    take it). ``store`` (path, model) keeps embeddings: only entries whose words are new are embedded."""
    vocab = vc.build_vocabulary(corpus, order_col=order_col)
    if embed_fn is None:
        return vocab
    words = vc.entry_lists(corpus, order_col=order_col).select("symbol", F.array_join("word", tx.SYNONYM_SEP).alias("_words"))
    return _embedded(vocab.join(words, "symbol"), "_words", embed_fn, store).drop("_words")


def decompose_sentences(sentences: DataFrame, vocab: DataFrame, id_col: str = "row_id") -> DataFrame:
    """``(id, sentence, fsw sequence)`` -> decomposed sentences (units, symbols)."""
    units = vc.lookup_signs(vc.explode_sequences(sentences, id_col, "fsw"), vocab)
    dec = vc.regroup_sentences(units, id_col)
    return sentences.select(id_col, "sentence").join(dec, id_col)


def profile_unknowns(units: DataFrame, vocab: DataFrame, top_n: int | None = None):
    """Unknown-sign frequencies; with ``top_n`` also labelled units and the extended vocabulary."""
    freq = vc.unknown_frequency(units)
    if top_n is None:
        return freq, units, vocab
    return freq, vc.label_unknowns(units, top_n), vc.append_unknown_entries(vocab, units, top_n)


map_signs_to_units = vc.map_signs_to_units


# ---- C5 ----------------------------------------------------------------------------------------

def build_training_sets(decomposed: DataFrame, corpus: DataFrame, id_col: str = "row_id",
                        seeds: list[int] | None = None) -> dict[str, DataFrame]:
    """Training variants: full, filtered (no unknown unit), 5 % of the filtered set, one 5 %
    sample of it per ablation seed, and train + vocabulary rows."""
    filtered = vc.drop_unknown_sentences(decomposed)
    small = sm.sample_fraction(filtered, id_col)
    return {
        "full": decomposed,
        "filtered": filtered,
        "filtered_5pct": small,
        "ablation": sm.sample_fraction_seeds(filtered, id_col, seeds),
        "train_plus_vocab": vc.union_with_vocabulary(decomposed, corpus),
    }


# ---- C6 / C7 / C8 ------------------------------------------------------------------------------

def retrieve_examples(queries: DataFrame, sentences: DataFrame, vocab: DataFrame,
                      direction: str = "text2sign"):
    """W1 examples (20 for text -> sign, 30 for sign -> text) and W2 canonical lists."""
    n = rv.SENTENCE_EXAMPLES_T2S if direction == "text2sign" else rv.SENTENCE_EXAMPLES_S2T
    examples = rv.similar_sentences(queries, sentences, n)
    canon = rv.similar_canonicals(queries, vocab) if direction == "text2sign" else None
    return examples, canon


def build_prompts(queries: DataFrame, sentences: DataFrame, vocab: DataFrame,
                  direction: str = "text2sign") -> DataFrame:
    """One message array per query. ``queries(q_id, text, q_vec)``,
    ``sentences(sentence_id, sentence, word, embedding)``."""
    examples, canon = retrieve_examples(queries, sentences, vocab, direction)
    ex = examples.join(sentences.select(F.col("sentence_id").alias("c_id"), "sentence",
                                        F.col("word").alias("decomposition")), "c_id")
    return pr.build_messages(queries, ex, canon, direction)


def ground_answers(answers: DataFrame, vocab: DataFrame, embed_fn=None, id_col: str = "q_id",
                   answer_col: str = "answer", store: tuple[str, str] | None = None) -> DataFrame:
    """Model answers -> grounded sign sequence, unit association and confidence.

    Units are embedded once per distinct text (``embed_fn``; with ``store``, once for all runs) and matched to entries."""
    flagged = answers.withColumn("needs_retry", tx.repetition_flag(tx.split_units(answer_col)))
    units = rv.answer_units(flagged, id_col, answer_col)
    texts = checkpoint(ix.dense_index(units.select("unit").distinct(), ["unit"], "vec_id"))
    vecs = _embedded(texts, "unit", embed_fn, store, dedupe=False)
    grounded = rv.nearest_exact(units.join(texts, "unit"), vocab, unit_text="unit", vectors=vecs.select("vec_id", "embedding"))
    conf = rv.geometric_confidence(grounded, [id_col])
    return flagged.select(id_col, answer_col, "needs_retry").join(conf, id_col, "left")


def ask_and_ground(prompts: DataFrame, ask: at.Ask, vocab: DataFrame, path: str, embed_fn=None,
                   store: tuple[str, str] | None = None, **kw) -> DataFrame:
    """Prompts -> answers, asked again where they repeat themselves (stored below ``path``), the last
    ones grounded on the vocabulary; adds ``attempts``."""
    last = at.last_answers(at.ask_with_retries(prompts, ask, path, **kw))
    grounded = ground_answers(last.select("q_id", "answer"), vocab, embed_fn, store=store)
    return grounded.join(last.select("q_id", "attempts"), "q_id")


# ---- C10 / C11 / C12 -----------------------------------------------------------------------------

def _null_safe_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    right = right.withColumnRenamed(key, f"_{key}")
    return left.join(right, left[key].eqNullSafe(right[f"_{key}"])).drop(f"_{key}")


def join_gold(pred: DataFrame, gold: DataFrame, modality: str = "text2sign") -> DataFrame:
    """Attach gold columns (m:n on the key, null keys matching each other, as pandas merge does)."""
    if modality == "text2sign":
        g = gold.select("sentence", F.col("fsw").alias("gold_fsw_seq"), F.col("symbol").alias("gold_symbol_seq"),
                        F.col("word").alias("gold_cd"))
        return _null_safe_join(pred, g, "sentence")
    g = gold.select("sentence", F.col("word").alias("gold_cd"))
    return _null_safe_join(pred, g, "gold_cd")


def evaluate_signs(pairs: DataFrame, pred: str = "pred_fsw_seq", gold: str = "gold_fsw_seq",
                   id_col: str = "row_id", factors: bool = False) -> dict[str, DataFrame]:
    """Sign predictions vs gold: per-row set F1 on symbols and its mean; coordinate distances, BLEU
    (effective order, and as on the command line) and chrF (case kept and lowered) of symbols as
    written and sorted; per-line BLEU and chrF of lines that are not blank."""
    p = F.col(pred)
    if factors:
        p = fx.factors_to_fsw(p)
    df = pairs.select(id_col, p.alias("_p"), F.col(gold).alias("_g"))
    df = df.withColumn("_pp", fx.parse_sign_seq("_p")).withColumn("_pg", fx.parse_sign_seq("_g"))
    df = df.withColumn("_sp", fx.sorted_seq(F.col("_pp"))).withColumn("_sg", fx.sorted_seq(F.col("_pg")))
    sides = [("p", "_pp"), ("g", "_pg"), ("sp", "_sp"), ("sg", "_sg")]
    wide = df.select(
        id_col, *[F.array_join(fx.flatten_signs(F.col(c), "tokens"), " ").alias(f"{n}_symbols") for n, c in sides],
        *[fx.flatten_signs(F.col(c), part).alias(f"{n}{part[0]}") for n, c in sides for part in ("xs", "ys")],
        tx.whitespace_tokens(fx.symbol_seq(F.col("_pp"))).alias("pt"), tx.whitespace_tokens(fx.symbol_seq(F.col("_pg"))).alias("gt"))
    f1 = mt.with_set_metrics(wide, "pt", "gt")  # on symbol ids without box letters
    # each line is parsed and compared once; all reports are sums or closed forms of these rows
    ordered = {False: ("p", "g", "as_written"), True: ("sp", "sg", "sorted")}
    lines = checkpoint(f1.select(
        id_col, F.col("p_symbols").alias("hyp"), F.col("g_symbols").alias("ref"), "precision", "recall", "f1",
        *[mt.distances(f"{a}x", f"{b}x", f"{a}y", f"{b}y").alias(f"{n}_distance") for a, b, n in ordered.values()],
        *[mt.line_stats(F.col(f"{a}_symbols"), F.col(f"{b}_symbols")).alias(f"{n}_stats") for a, b, n in ordered.values()]))
    sums = lambda n: F.struct(*[F.sum(f"{n}_distance.{a}").alias(b) for a, b in mt.DISTANCE_TOTALS.items()])
    totals = checkpoint(lines.agg(F.array(*[F.struct(F.lit(o).alias("ordered"), mt.sum_stats(f"{n}_stats").alias("s"), sums(n).alias("d"))
                                            for o, (_, _, n) in ordered.items()]).alias("_t")).select(F.inline("_t")))  # two rows
    bleu = lambda effective: totals.select(mt.bleu_score(F.col("s"), effective).alias("bleu"), "s.hyp_len", "s.ref_len", "ordered")
    return {
        "f1_rows": lines.select(id_col, "precision", "recall", "f1"),
        "f1_mean": mt.macro_means(lines),
        "distance": mt.mean_distances(totals.select("d.*", "ordered")),
        "bleu": bleu(True),
        "bleu_cli": bleu(False),
        "chrf": totals.select(mt.chrf_score(F.col("s")).alias("chrf"), mt.chrf_score(mt.lower_stats(F.col("s"))).alias("chrf_lower"), "ordered"),
        "per_line": mt.line_scores(lines.select(id_col, "hyp", "ref", F.col("as_written_stats").alias("stats"))),
    }


def evaluate_sign_lines(pred: DataFrame, gold: DataFrame, id_col: str = "row_id", fsw_col: str = "fsw",
                        factors: bool = False) -> dict[str, DataFrame]:
    """``evaluate_signs`` of two line tables, joined by line number; unequal lines are an error."""
    pairs = mt.align_by_position(pred.select(id_col, F.col(fsw_col).alias("pred_fsw_seq")),
                                 gold.select(id_col, F.col(fsw_col).alias("gold_fsw_seq")), id_col, enforce=True)
    return evaluate_signs(pairs, id_col=id_col, factors=factors)


ALIGNED_COLUMNS = ["fsw", "symbols", "symbols_ordered", "xs", "ys", "xs_ordered", "ys_ordered", "sentence"]


def aligned_columns(sentences: DataFrame, vocabulary: DataFrame | None = None, order_col: str = "row_id") -> DataFrame:
    """The eight line-aligned columns of a split: signs, symbols, symbols in order, their coordinates
    in both orders, and text. ``vocabulary`` (word, fsw) adds its rows after the sentences: for
    the train split. ``sentences`` has ``order_col``, sentence, fsw."""
    rows = sentences.select(F.lit(0).alias("part"), F.col(order_col).cast("bigint").alias(order_col), F.col("sentence").cast("string"), "fsw")
    if vocabulary is not None:
        words = vocabulary.select(F.lit(1).alias("part"), F.col(order_col).cast("bigint").alias(order_col), F.col("word").alias("sentence"), "fsw")
        rows = rows.unionByName(words)
    rows = rows.withColumn("_p", fx.parse_sign_seq("fsw"))
    rows = rows.withColumn("_s", fx.sorted_seq(F.col("_p")))
    text = lambda c, part: F.array_join(fx.flatten_signs(F.col(c), part).cast("array<string>"), " ")
    return rows.select("part", order_col, F.array_join(fx.split_signs("fsw"), " ").alias("fsw"),
                       text("_p", "tokens").alias("symbols"), text("_s", "tokens").alias("symbols_ordered"),
                       text("_p", "xs").alias("xs"), text("_p", "ys").alias("ys"),
                       text("_s", "xs").alias("xs_ordered"), text("_s", "ys").alias("ys_ordered"), "sentence")


def evaluate_text(pairs: DataFrame, pred: str = "pseudo_sentence", gold: str = "sentence") -> dict[str, DataFrame]:
    """Text predictions vs gold: newlines collapsed, null as blank; corpus BLEU / chrF over
    every line and per-line scores for non-blank lines."""
    df = pairs.select(F.coalesce(tx.collapse_newlines(pred), F.lit("")).alias("hyp"),
                      F.coalesce(tx.collapse_newlines(gold), F.lit("")).alias("ref"), *[
                          c for c in pairs.columns if c not in (pred, gold)])
    stats = ix.fresh_name(df, "stats")
    lines = checkpoint(df.withColumn(stats, mt.line_stats(F.col("hyp"), F.col("ref"))))  # each pair goes through Python once
    totals = checkpoint(lines.agg(mt.sum_stats(stats).alias("s")))
    return {"bleu": totals.select(mt.bleu_score(F.col("s")).alias("bleu"), "s.hyp_len", "s.ref_len"),
            "chrf": totals.select(mt.chrf_score(F.col("s")).alias("chrf"), mt.chrf_score(mt.lower_stats(F.col("s"))).alias("chrf_lower")),
            "per_line": mt.line_scores(lines, stats)}
