"""Query-log screening and hashing expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Statement kinds that a read-only log must not hold.
FORBIDDEN = ["insert", "update", "delete", "merge", "create", "drop", "alter", "command", "transaction", "commit", "rollback", "grant", "revoke", "use", "set", "copy", "attach", "detach", "install", "load"]


def bare_sql(sql: Column) -> Column:
    """The text without string literals and comments."""
    return F.regexp_replace(F.regexp_replace(sql, r"'([^']|'')*'", "''"), r"--[^\n]*|/\*([^*]|\*[^/])*\*/", " ")


def screen_statements(queries: DataFrame, sql_col: str = "sql_text") -> DataFrame:
    """Adds screen_reason: null, UNSUPPORTED_STATEMENT or MULTIPLE_STATEMENTS. Conservative, not a parse: a forbidden word anywhere outside literals counts."""
    bare = bare_sql(F.coalesce(F.col(sql_col), F.lit("")))
    parts = F.size(F.filter(F.split(bare, ";"), lambda s: F.trim(s) != ""))
    word = r"\b(" + "|".join(FORBIDDEN) + r")\b"
    first = F.lower(F.regexp_extract(bare, r"^\s*\(*\s*([A-Za-z]+)", 1))
    reason = F.when(parts == 0, "UNSUPPORTED_STATEMENT").when(parts > 1, "MULTIPLE_STATEMENTS").when(~first.isin("select", "with") | F.lower(bare).rlike(word), "UNSUPPORTED_STATEMENT")
    return queries.withColumn("screen_reason", reason)


def text_budget(queries: DataFrame, max_bytes: int = 100_000, sql_col: str = "sql_text") -> DataFrame:
    """Adds n_bytes and over_budget."""
    return queries.withColumn("n_bytes", F.octet_length(sql_col).cast("long")).withColumn("over_budget", F.col("n_bytes") > max_bytes)


def redact_sql(sql: Column) -> Column:
    """String and number literals become ?."""
    return F.regexp_replace(F.regexp_replace(sql, r"'([^']|'')*'", "?"), r"\b[0-9]+(\.[0-9]+)?\b", "?")


def sql_sha(sql: Column) -> Column:
    return F.sha2(sql, 256)


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA-256 of a string column, in hex, from two native digests."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    lit = lambda b: F.unhex(F.lit(b.hex()))
    return F.sha2(F.concat(lit(outer), F.unhex(F.sha2(F.concat(lit(inner), message.cast("binary")), 256))), 256)


@F.pandas_udf(T.StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def _is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def _with_fold(rows: DataFrame, source: str, name: str) -> DataFrame:
    """Adds the normal form KC of a text column; ASCII is its own, so only other rows meet Python."""
    ascii_ = _is_ascii(F.col(source))
    return rows.where(ascii_).withColumn(name, F.col(source)).unionByName(rows.where(~ascii_).withColumn(name, _folded(source)))


def _needles(secrets: DataFrame) -> DataFrame:
    """Spellings of each secret: secret_id, spelling, needle, and the needle's first 8, 4 or 1 characters (gram, of n_gram)."""
    raw = F.col("secret").cast("binary")
    forms = {"raw": F.col("secret"), "percent": F.url_encode("secret"), "hex": F.lower(F.hex(raw)), "base64": F.translate(F.base64(raw), "\r\n", ""), "nfkc": F.col("fold")}
    known = _with_fold(secrets.select("secret_id", "secret").where("length(secret) > 0"), "secret", "fold")
    each = known.select("secret_id", F.inline(F.array(*(F.struct(F.lit(k).alias("spelling"), v.alias("needle")) for k, v in forms.items()))))
    n = F.when(F.length("needle") >= 8, 8).when(F.length("needle") >= 4, 4).otherwise(1)
    return each.where("length(needle) > 0").distinct().withColumn("n_gram", n).withColumn("gram", F.expr("left(needle, n_gram)"))


SHORT_LIST = 8 << 10  # bytes of needles (about 100) up to which each text is searched for all of them, which costs less than its grams
SMALL_LIST = 16 << 20  # bytes of needles up to which tasks get all of them; a longer list is shuffled by gram
PIECE = 4096  # characters of a text that are cut into grams at a time, which bounds a row's memory


def _met(rows: DataFrame, needles: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """text_hash, cands: the needles of which a text holds the gram."""
    # an ASCII text is searched for both kinds of needle at once
    own = rows.select("text_hash", "text", _is_ascii(F.col("text")).alias("ascii"))
    folded = own.where("not ascii").select("text_hash", _folded("text").alias("text"), F.array(F.lit(True)).alias("kinds"))
    plain = own.select("text_hash", "text", F.when(F.col("ascii"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False))).alias("kinds"))
    pieces = plain.unionByName(folded).select("text_hash", "kinds", F.explode(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{1,{PIECE + 7}}})).{{1,{PIECE}}}"), 1)).alias("piece"))
    grams = F.array_distinct(F.concat(*(F.regexp_extract_all("piece", F.lit(f"(?s)(?=(.{{{n}}}))."), 1) for n in sizes)))
    listed = needles.select("gram", "secret_id", "spelling", "needle", (F.col("spelling") == "nfkc").alias("kind"))
    met = pieces.select("text_hash", "kinds", F.explode(grams).alias("gram")).join(F.broadcast(listed) if small else listed, "gram").where(F.array_contains("kinds", F.col("kind")))
    return met.groupBy("text_hash").agg(F.collect_set(F.struct("secret_id", "spelling", "needle")).alias("cands"))


def scan_secrets(corpus: DataFrame, text_col: str, secrets: DataFrame) -> DataFrame:
    """Texts that hold a listed secret (secret_id, secret) raw, percent-encoded, in hex or in base64; or `nfkc`: only once text and secret are in normal form KC.

    Adds secret_id and spelling, a row for each that a text holds; repeated texts each get theirs. Null texts and empty secrets
    hold and are nothing. The list may have any length: texts meet it by an equi-join on grams of 8 characters (4 or 1
    for short needles) of which only a 64-bit hash of the text is kept, so neither the list nor a text passes through the driver or
    is copied to each gram. Texts that share a gram with a needle are then searched for it, so the hash decides nothing.
    Where the list is so short that cutting a text into grams takes longer, texts are searched for all of it at once.
    """
    text = F.col(f"`{text_col}`")
    rows = corpus.select(F.struct("*").alias("row"), text.alias("text")).where("text is not null").withColumn("text_hash", F.xxhash64("text"))
    needles = _needles(secrets)
    lists = needles.groupBy("n_gram").agg(F.sum(F.octet_length("needle") + 64).alias("bytes")).collect()  # of 8, 4 and 1 at most
    sizes, n_bytes = sorted(r.n_gram for r in lists), sum(r.bytes for r in lists)
    if not sizes:
        return corpus.sparkSession.createDataFrame([], T.StructType([*corpus.schema.fields, secrets.schema["secret_id"], T.StructField("spelling", T.StringType())]))

    if n_bytes <= SHORT_LIST:
        asked = rows.drop("text_hash").crossJoin(F.broadcast(needles.agg(F.collect_set(F.struct("secret_id", "spelling", "needle")).alias("cands"))))
    else:
        asked = rows.join(_met(rows, needles, sizes, n_bytes <= SMALL_LIST), "text_hash").drop("text_hash")
    fold = F.exists("cands", lambda c: c.spelling == "nfkc") & ~_is_ascii(F.col("text"))
    asked = asked.where(~fold).withColumn("fold", F.col("text")).unionByName(asked.where(fold).withColumn("fold", _folded("text")))
    held = F.filter("cands", lambda c: F.when(c.spelling == "nfkc", F.contains("fold", c.needle)).otherwise(F.contains("text", c.needle)))
    shown = F.transform(F.filter("held", lambda c: c.spelling == "raw"), lambda c: c.secret_id)
    hits = asked.withColumn("held", held).withColumn("shown", shown)
    hits = hits.withColumn("hits", F.array_distinct(F.transform(F.filter("held", lambda c: (c.spelling != "nfkc") | ~F.array_contains("shown", c.secret_id)), lambda c: F.struct(c.secret_id.alias("secret_id"), c.spelling.alias("spelling")))))
    return hits.select("row", F.explode("hits").alias("hit")).select("row.*", "hit.secret_id", "hit.spelling")
