"""Secrets: base patterns, and multipart credentials linked by an interval join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_row, from_row, let, named, others, stash
from .spans import SPAN, count, digest, found, meets, none, of_kind

KINDS = ("assign", "access", "hex")
#: The added kinds: an identifier, a bare secret, and an endpoint, reported only beside their complements.
WEAK = ("ident", "secret", "endpoint")
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: A name for a user, client or key, and its value.
IDENT_NAME = r"(?i:\b(?:user(?:_?name|_?id)?|login|account(?:_?id|_?name)?|client_?id|tenant_?id|app_?id|(?:aws_?)?access_?key_?id)\b)[\"']?\x20*[:=]\x20*[\"']?"
IDENT = IDENT_NAME + r"[A-Za-z0-9._@+-]*[A-Za-z0-9]"
SECRET = r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"(?:https?|s3|ftp|sftp|ssh|amqps?|jdbc:[a-z]+|mysql|mongodb(?:\+srv)?|rediss?|postgres(?:ql)?)://[A-Za-z0-9._:@/-]+|(?<![A-Za-z0-9.-])(?:s3|sts|iam|ec2|dynamodb)[A-Za-z0-9.-]*\.amazonaws\.com"


def base_spans(text: Column) -> Column:
    """The base spans by start, then kind as listed."""
    key = lambda x: F.regexp_extract(x["m"], ASSIGN, 2)
    spans = F.concat(F.filter(found(text, ASSIGN, "assign", "(?i)passw|secret|token|api_?key"), lambda x: F.length(key(x)) >= 8), found(text, ACCESS, "access", "AKIA"), found(text, HEX, "hex", HEX))
    return ordered(spans)


def ordered(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS + WEAK))
    keyed = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.array_position(names, x["kind"]).alias("k"), x["e"].alias("e"), x["kind"].alias("kind"), x["m"].alias("m")))
    return F.when(F.size(spans) < 2, spans).otherwise(F.transform(F.array_sort(keyed), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"))).cast(SPAN))


def weak_candidates(text: Column) -> Column:
    """By kind: values of names for users and clients; 20 and more characters of base 64 with upper and lower case and digits; endpoints."""
    mixed = lambda x: x["m"].rlike("[A-Z]") & x["m"].rlike("[a-z]") & x["m"].rlike("[0-9]")
    secrets = F.filter(found(text, SECRET, "secret", "[A-Za-z0-9+/_-]{20}"), mixed)
    return F.struct(found(text, IDENT, "ident", IDENT_NAME).alias("ident"), secrets.alias("secret"), found(text, ENDPOINT, "endpoint", "://|amazonaws").alias("endpoint"))


def weak_spans(base: Column, candidates: Column) -> Column:
    """The candidates, which alone say little, that touch neither a base span nor one of an earlier kind."""

    def widened(lists: Column, made: list[str], kinds: list[str]) -> Column:
        if not kinds:
            return F.concat(*[lists[k] for k in WEAK])
        free = F.filter(candidates[kinds[0]], lambda x: ~meets(x, *[lists[k] for k in made]))
        more = let(free, lambda x: F.struct(*[lists[k].alias(k) for k in made], x.alias(kinds[0])))
        return let(more, lambda x: widened(x, [*made, kinds[0]], kinds[1:]))

    return let(F.struct(*[of_kind(base, k).alias(k) for k in KINDS]), lambda x: widened(x, list(KINDS), list(WEAK)))


#: What role a span has in a credential, and the roles one of which each weak kind needs beside it.
ROLE = {"access": "id", "ident": "id", "assign": "secret", "hex": "secret", "secret": "secret", "endpoint": "endpoint"}
NEEDS = {"ident": ("secret",), "secret": ("id",), "endpoint": ("id", "secret")}


def linked(parts: DataFrame, reach: int) -> DataFrame:
    """(row, kind, s, e) of the weak parts whose complement lies within reach code points in the same text.

    parts: (row, kind, s, e), end exclusive. A bare secret needs an identifier, of either kind; an identifier needs a secret,
    found by its pattern or bare; an endpoint needs a secret or an identifier that is a base span or reported itself. Parts
    meet by (row, scope), a scope being reach code points long: a part is sent to the scopes that it touches, a weak
    one to those that its reach touches, so ranges are compared inside scopes, never over a whole text. A weak part's
    range, twice as long as a scope, holds at least one end of each scope that it touches, so of the complements in a
    scope, cut to it, the smallest start and the largest end decide.
    """
    scope = lambda c: F.floor(c / reach)

    def near(weak: DataFrame, other: DataFrame) -> DataFrame:
        cut = other.select("row", "s", "e", F.explode(F.sequence(scope(F.col("s")), scope(F.col("e")))).alias("scope"))
        ends = cut.groupBy("row", "scope").agg(F.min(F.greatest("s", F.col("scope") * reach)).alias("first"), F.max(F.least("e", (F.col("scope") + 1) * reach)).alias("last"))
        sent = weak.withColumn("scope", F.explode(F.sequence(scope(F.col("s") - reach), scope(F.col("e") + reach))))
        hit = (F.col("first") <= F.col("e") + reach) & (F.col("last") >= F.col("s") - reach)
        return sent.join(ends, ["row", "scope"]).where(hit).select("row", "kind", "s", "e").distinct()

    def of(role: str, table: DataFrame = parts) -> DataFrame:
        return table.where(F.col("kind").isin(*[k for k, r in ROLE.items() if r == role]))

    out = None
    for kind in ("ident", "secret"):
        hits = near(parts.where(F.col("kind") == kind), of(NEEDS[kind][0]))
        out = hits if out is None else out.unionByName(hits)
    out = stash(out)
    sure = parts.where(F.col("kind").isin(*KINDS)).select("row", "kind", "s", "e").unionByName(out)
    return out.unionByName(near(parts.where("kind = 'endpoint'"), sure))


def detect(docs: DataFrame, text: str = "text", reach: int = 400) -> DataFrame:
    """docs' other columns with base and spans, arrays of (kind, s, e, m) in code points, end exclusive; m is empty for added ones.

    Rows are known by a hash of their texts, so repeated texts share their spans and none multiplies. Null and empty texts
    have no spans; an empty table gives an empty result; columns that clash with a result are replaced. Texts are
    read once: what was found goes to the shared folder, and only texts with weak parts enter the joins. A text's
    spans, never more than its length allows, are together in one row.
    """
    keep = others(docs, text, "base", "spans")
    whole = F.coalesce(named(text).cast("string"), F.lit(""))
    key = F.concat_ws("-", F.xxhash64(whole), F.xxhash64(F.lit(1), whole), F.length(whole))
    seen = stash(docs.select(as_row(keep).alias("row"), key.alias("key"), base_spans(whole).alias("base"), weak_candidates(whole).alias("candidates")))
    some = seen.where(F.greatest(*[F.size(f"candidates.{k}") for k in WEAK]) > 0).groupBy("key").agg(F.first("base").alias("base"), F.first("candidates").alias("candidates"))
    some = some.select("key", "base", weak_spans(F.col("base"), F.col("candidates")).alias("weak")).where(F.size("weak") > 0)
    parts = stash(some.select(F.col("key").alias("row"), F.explode(F.concat("base", "weak")).alias("x")).select("row", "x.kind", "x.s", "x.e"))
    added = stash(linked(parts, reach).groupBy(F.col("row").alias("of")).agg(F.collect_list(F.struct("kind", "s", "e", F.lit("").alias("m"))).alias("added")))
    return seen.join(added, seen["key"] == added["of"], "left").select(*from_row(keep), "base", ordered(F.concat("base", F.coalesce("added", none()).cast(SPAN))).alias("spans"))


def report(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, numbers of base spans by kind, their digest, and all spans as one string."""
    out = detect(docs.select("doc_id", text), text)
    return out.select("doc_id", *[count(F.col("base"), k).alias(f"n_{k}") for k in KINDS], F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
