"""Formal SignWriting (FSW) column functions, all built-in Spark expressions.

A sign string is an optional prefix ``A`` + symbols without coordinates, a box
``[BLMR]ddd x ddd`` and then symbols ``S[123][0-9a-f]{2}[0-5][0-9a-f]`` each followed by
``ddd x ddd``. The parsed form is

    STRUCT<box: STRING, x: INT, y: INT,
           symbols: ARRAY<STRUCT<pos: INT, symbol: STRING, x: INT, y: INT>>>
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import whitespace_tokens

# Fixed values of the sign grammar.
SYMBOL_WITH_COORDS = r"S[123][0-9a-f]{2}[0-5][0-9a-f]\d{3}x\d{3}"
BOX_WITH_COORDS = r"([BLMR])(\d{3})x(\d{3})"
DEFAULT_BOX = ("M", 500, 500)
# Padding value used when two coordinate lists have different lengths.
COORD_FILL = 482


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_signs(fsw_seq: Column | str) -> Column:
    """Whitespace-separated sign sequence -> ARRAY<STRING> of signs (empty tokens dropped)."""
    return whitespace_tokens(fsw_seq)


def parse_sign(sign: Column | str) -> Column:
    """Parse one sign string into the struct described in the module doc."""
    s = _col(sign)
    box = F.regexp_extract(s, BOX_WITH_COORDS, 1)
    has_box = box != ""
    toks = F.regexp_extract_all(s, F.lit(SYMBOL_WITH_COORDS), 0)
    symbols = F.transform(toks, lambda t, i: F.struct(
        i.alias("pos"),
        F.substring(t, 1, 6).alias("symbol"),
        F.substring(t, 7, 3).cast("int").alias("x"),
        F.substring(t, 11, 3).cast("int").alias("y"),
    ))
    return F.struct(
        F.when(has_box, box).otherwise(F.lit(DEFAULT_BOX[0])).alias("box"),
        F.when(has_box, F.regexp_extract(s, BOX_WITH_COORDS, 2).cast("int"))
         .otherwise(F.lit(DEFAULT_BOX[1])).alias("x"),
        F.when(has_box, F.regexp_extract(s, BOX_WITH_COORDS, 3).cast("int"))
         .otherwise(F.lit(DEFAULT_BOX[2])).alias("y"),
        symbols.alias("symbols"),
    )


def sorted_symbols(parsed: Column) -> Column:
    """Symbols of a parsed sign sorted by symbol id; ties keep their original order."""
    return F.array_sort(parsed["symbols"], lambda a, b: F.when(a["symbol"] < b["symbol"], -1)
                        .when(a["symbol"] > b["symbol"], 1)
                        .otherwise(a["pos"] - b["pos"]))


def with_sorted_symbols(parsed: Column) -> Column:
    return parsed.withField("symbols", sorted_symbols(parsed))


def sign_tokens(parsed: Column) -> Column:
    """Flat tokens of one sign: box letter then each symbol id."""
    return F.concat(F.array(parsed["box"]), F.transform(parsed["symbols"], lambda s: s["symbol"]))


def sign_xs(parsed: Column) -> Column:
    return F.concat(F.array(parsed["x"]), F.transform(parsed["symbols"], lambda s: s["x"]))


def sign_ys(parsed: Column) -> Column:
    return F.concat(F.array(parsed["y"]), F.transform(parsed["symbols"], lambda s: s["y"]))


def flatten_signs(parsed_signs: Column, part: str) -> Column:
    """Flat list over an ARRAY of parsed signs: ``part`` in {'tokens', 'xs', 'ys'}."""
    fn = {"tokens": sign_tokens, "xs": sign_xs, "ys": sign_ys}[part]
    return F.flatten(F.transform(parsed_signs, fn))


def symbol_ids(parsed: Column, order: bool = False) -> Column:
    """Symbol ids of one sign without its box (optionally sorted)."""
    ids = F.transform(parsed["symbols"], lambda s: s["symbol"])
    return F.array_sort(ids) if order else ids


def symbol_string(parsed: Column, order: bool = False, add_box_symbol: bool = False) -> Column:
    """One sign's symbols joined by a space, the box letter removed (or put first)."""
    body = F.array_join(symbol_ids(parsed, order), " ")
    if add_box_symbol:
        return F.concat_ws(" ", parsed["box"], body)
    return body


def symbol_key(fsw: Column | str) -> Column:
    """Order-free multiset key of one sign: its symbol ids sorted and space-joined."""
    return symbol_string(parse_sign(fsw), order=True)


def clean_sign_seq(fsw_seq: Column | str, sort: bool = False, glue: str = " ") -> Column:
    """``clean_parsed`` of one expression, for single outputs."""
    parsed = parse_sign_seq(fsw_seq)
    return clean_parsed(sorted_seq(parsed) if sort else parsed, fsw_seq, glue)


def clean_symbol_seq(fsw_seq: Column | str, glue: str = " ", order: bool = False,
                     add_box_symbol: bool = False) -> Column:
    """Per-sign symbol strings of a sign sequence, joined by ``glue``."""
    return symbol_seq(parse_sign_seq(fsw_seq), glue, order, add_box_symbol)


def symbol_seq(parsed: Column, glue: str = " ", order: bool = False, add_box_symbol: bool = False) -> Column:
    """Per-sign symbol strings of a parsed sign sequence, joined by ``glue``."""
    return F.array_join(
        F.transform(parsed, lambda p: symbol_string(p, order, add_box_symbol)), glue)


def parse_sign_seq(fsw_seq: Column | str) -> Column:
    """ARRAY of parsed signs of a sign sequence. Keep it in a column of its own (``withColumn``) and
    build on that column: the optimizer copies no costly expression that is used more than
    once, so each sign is parsed once for all outputs."""
    return F.transform(split_signs(fsw_seq), parse_sign)


def sorted_seq(parsed: Column) -> Column:
    return F.transform(parsed, with_sorted_symbols)


def clean_parsed(parsed: Column, fsw_seq: Column | str, glue: str = " ") -> Column:
    """(fsw, symbols, xs, ys) of a parsed sign sequence as a struct of glue-joined strings."""
    return F.struct(
        F.array_join(split_signs(fsw_seq), glue).alias("fsw"),
        F.array_join(flatten_signs(parsed, "tokens"), glue).alias("symbols"),
        F.array_join(flatten_signs(parsed, "xs").cast("array<string>"), glue).alias("xs"),
        F.array_join(flatten_signs(parsed, "ys").cast("array<string>"), glue).alias("ys"),
    )


def symbol_to_pseudo_fsw(symbols: Column | str) -> Column:
    """Space-separated symbol ids -> a pseudo sign centred at 500x500."""
    s = _col(symbols)
    return F.concat(F.lit("M500x500"), F.replace(s, F.lit(" "), F.lit("500x500")), F.lit("500x500"))


def factor_token_to_fsw(token: Column) -> Column:
    """``sym|x|y`` -> ``symxxxxy``; any other token is kept."""
    parts = F.split(token, r"\|")
    return F.when(F.size(parts) == 3,
                  F.concat(parts[0], parts[1], F.lit("x"), parts[2])).otherwise(token)


def factors_to_fsw(line: Column | str) -> Column:
    """A line of factor tokens -> FSW: rebuild each token, then glue symbols onto signs."""
    toks = whitespace_tokens(line)
    joined = F.array_join(F.transform(toks, factor_token_to_fsw), " ")
    return F.replace(joined, F.lit(" S"), F.lit("S"))


def fsw_to_factors(fsw_seq: Column | str) -> Column:
    """Inverse view used by fixtures: each box/symbol written as ``sym|x|y`` tokens."""
    parsed = F.transform(split_signs(fsw_seq), parse_sign)
    per_sign = F.transform(parsed, lambda p: F.concat(
        F.array(F.concat_ws("|", p["box"], p["x"].cast("string"), p["y"].cast("string"))),
        F.transform(p["symbols"], lambda s: F.concat_ws("|", s["symbol"], s["x"].cast("string"),
                                                         s["y"].cast("string")))))
    return F.array_join(F.flatten(per_sign), " ")
