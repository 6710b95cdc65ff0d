"""Personal data: validated base patterns, and candidates chosen by boosted trees. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import as_row, from_row, let, named, others, stash
from .spans import SPAN, count, digest, found, hidden, joined, meets, none, of_kind, pieces

KINDS = ("email", "ip", "card", "phone")
#: What must hold of a text for a kind to occur at all; spares most texts the patterns.
AT, DIGITS = "@|[(\\[][Aa][Tt][)\\]]", "[0-9][ ().-]{0,3}[0-9]"
#: The base patterns, over texts whose dots between host characters, or single blanks and hyphens between digits, are marked (spans.joined).
#: A possessive run starts where the last match ended or where no earlier character could start it, so long runs take linear time.
HOST = "A-Za-z0-9-"
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+\x01-]))[A-Za-z0-9._%+\x01-]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"(?:\G|(?<![0-9\x01\x02]))[0-9][0-9\x01\x02]++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: A dot, also as written to hide an address.
DOT = r"(?:\[\.\]| \. |\.|[(\[][Dd][Oo][Tt][)\]])"
#: A further part of a host; from the eighth on only plain ones, as a class.
PART = r"(?: ?(?:\.|[(\[][Dd][Oo][Tt][)\]]) ?[A-Za-z0-9-]++)"
#: The generators: more than the base patterns accept. Cards are whole runs of digits, as in the base.
LOOSE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|[(\[][Aa][Tt][)\]]) ?[A-Za-z0-9-]++(?:{PART}{{8}}(?:[A-Za-z0-9.-]*[A-Za-z0-9-])?|{PART}{{1,7}})",
    "ip": rf"(?<![0-9.])[0-9]{{1,3}}(?: ?{DOT} ?[0-9]{{1,3}}){{3}}(?![0-9])",
    "card": r"(?<![0-9])(?<![0-9][ .-])(?<![0-9][ .-]{2})[0-9](?:[ .-]{0,2}[0-9]){12,18}(?![ .-]{0,2}[0-9])",
    "phone": r"(?<![0-9])\+?\(?[0-9][ ().0-9-]{5,}[0-9]",
}
#: Dotted quads and lists of years have as many digits as phone numbers.
NO_PHONE = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$|^((19|20)[0-9]{2}[ ,.-]*)+$"
FEATURES = ("valid", "grouped", "separated", "cue", "glued")


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def octets(m: Column) -> Column:
    """Every dotted part is at most 255."""
    return F.forall(F.split(m, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda q: (F.length(q) <= 3) & (F.when(F.length(q) <= 3, q).otherwise("999").cast("int") <= 255)))


def luhn(d: Column) -> Column:
    """The check sum of a string of digits; only asked of short ones."""
    each = F.transform(F.split(F.reverse(d), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(let(x.cast("int") * 2, lambda y: F.when(y > 9, y - 9).otherwise(y))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def card_ok(m: Column) -> Column:
    return let(digits(m), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))


def phone_ok(m: Column) -> Column:
    return F.length(digits(m)).between(8, 15)


def plain(m: Column) -> Column:
    """An address without what hides it: (at), [dot], [.] and blanks."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(m, r"\[\.\]|[(\[][Dd][Oo][Tt][)\]]", "."), r"[(\[][Aa][Tt][)\]]", "@"), " ", "")


def base_spans(text: Column) -> Column:
    """The validated spans, by kind as listed, then start. Matches that fail are dropped without a second try."""
    parts = [
        found(text, EMAIL, "email", "@", ".", joined(text, HOST, ".")),
        F.filter(found(text, IP, "ip", r"[0-9]\.[0-9]"), lambda x: octets(x["m"])),
        F.filter(found(text, CARD, "card", DIGITS, " -", joined(text, "0-9", " -")), lambda x: card_ok(x["m"])),
        F.filter(found(text, PHONE, "phone", r"\+[0-9]"), lambda x: phone_ok(x["m"])),
    ]
    return F.concat(*parts)


def candidates(text: Column) -> Column:
    """Overlapping proposals of all generators with format and context features; kind, s, e and the features.

    The features leave out what defines a base match (the plus of a phone number, the plain @), so that what
    looks and stands like base spans scores like them.
    """
    cues = {"email": "mail|contact|write", "ip": "ip|addr|host|server", "card": "card|visa|credit|account", "phone": "phone|tel|call|fax|mobile"}
    valid = {"email": lambda m: m.rlike(r"[A-Za-z]{2,6}$"), "ip": lambda m: octets(plain(m)), "card": lambda m: let(digits(m), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False))), "phone": lambda m: phone_ok(m) & ~m.rlike(NO_PHONE)}
    shape = {
        "email": r"^[A-Za-z][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+){1,8}$",
        "ip": r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$",
        "card": r"^(([0-9]{4}[ .-]{0,2}){3,4}[0-9]{1,4}|3[47][0-9]{2}[ .-]{0,2}[0-9]{6}[ .-]{0,2}[0-9]{5})$",
        "phone": r"^(\+?[0-9]{1,3}[ .-])?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}$",
    }

    def of(kind: str, hint: str) -> Column:
        def described(x: Column) -> Column:
            before = F.lower(x["last"])
            return F.struct(
                F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.coalesce(valid[kind](x["m"]), F.lit(False)).alias("valid"), (plain(x["m"]) if kind in ("email", "ip") else x["m"]).rlike(shape[kind]).alias("grouped"), x["m"].rlike("[ ().-]").alias("separated"),
                before.rlike(cues[kind]).alias("cue"), (before.rlike("[A-Za-z0-9]$") | x["next"].rlike("[A-Za-z0-9]")).alias("glued"),
            )

        return F.transform(pieces(text, LOOSE[kind], hint), described)

    return F.concat(of("email", AT), of("ip", rf"[0-9] ?{DOT} ?[0-9]"), of("card", DIGITS), of("phone", DIGITS))


def proposals(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """row (docs' columns keep), base, candidates and fold (by the text's hash, 0 or 1) of every whole text (null: empty); a map without shuffle."""
    whole = F.coalesce(named(text).cast("string"), F.lit(""))
    return docs.select(as_row(keep).alias("row"), base_spans(whole).alias("base"), candidates(whole).alias("candidates"), F.pmod(F.xxhash64(whole), F.lit(2)).alias("fold"))


def learn(proposed: DataFrame, precision: float = 0.9) -> dict[str, boosting.Model]:
    """A model for each kind: does a candidate coincide with a validated span? Fitted on candidates, counted by pattern.

    A candidate that the base patterns miss though it passes its kind's check in a real format, and stands free, is
    neither a positive nor a negative, as it may well be what is sought; nor is one that touches a base span of another kind, or
    for phones a valid address or card. All others without a base span are negatives. The trees are fitted on one half of
    the texts and the threshold is calibrated on the other. At most 2 ** (len(FEATURES) + 1) rows for each kind come to
    the driver.
    """
    valid = F.filter("candidates", lambda x: x["valid"])
    sorted_ = F.struct(*[of_kind(F.col("base"), k).alias(f"b_{k}") for k in KINDS], *[of_kind(valid, k).alias(f"c_{k}") for k in ("ip", "card")])

    def labels(of: Column) -> Column:
        hit = lambda x: F.coalesce(*[F.when(x["kind"] == k, meets(x, of[f"b_{k}"])) for k in KINDS])
        other = lambda x: F.coalesce(*[F.when(x["kind"] == k, meets(x, *[of[f"b_{o}"] for o in KINDS if o != k])) for k in KINDS])
        taken = lambda x: (x["kind"] == "phone") & meets(x, of["c_ip"], of["c_card"])
        return F.transform("candidates", lambda x: F.struct(x.alias("x"), hit(x).alias("hit"), (x["valid"] & x["grouped"] & ~x["glued"] | other(x) | taken(x)).alias("open")))

    labelled = let(sorted_, labels)
    each = proposed.where(F.size("candidates") > 0).select("fold", F.explode(labelled).alias("y")).select("fold", "y.*").where("hit or not open")
    counted = each.select(F.col("x.kind").alias("kind"), *[F.col(f"x.{f}").alias(f) for f in FEATURES], "hit", "fold").groupBy("kind", "fold", *FEATURES).agg(F.sum(F.col("hit").cast("long")).alias("hits"), F.count("*").alias("n"))
    rows: dict[str, tuple[list[boosting.Row], list[boosting.Row]]] = {k: ([], []) for k in KINDS}
    for r in counted.collect():
        rows[r["kind"]][r["fold"]].append((tuple(r[f] for f in FEATURES), r["hits"], r["n"]))
    return {k: boosting.fit(own, len(FEATURES), precision=precision, held=held) for k, (own, held) in rows.items()}


def chosen(base: Column, candidate: Column, models: dict[str, boosting.Model]) -> Column:
    """All spans, by kind as listed, then start: the base ones, and candidates over their kind's threshold that touch no base span
    and no chosen candidate of a kind listed earlier."""
    def added(kind: str, lists: Column, made: list[str]) -> Column:
        """Chosen candidates of a kind, that touch nothing in the fields `made` of lists."""
        passes = lambda x: (x["kind"] == kind) & (models[kind].column([x[f] for f in FEATURES]) >= models[kind].threshold)
        return F.transform(F.filter(candidate, lambda x: passes(x) & ~meets(x, *[lists[m] for m in made])), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lit("").alias("m")))

    def widened(lists: Column, made: list[str], kinds: list[str]) -> Column:
        """base and what is added, kind after kind; lists has the spans of each kind so far, in order."""
        if not kinds:
            return F.concat(base, *[lists[m] for m in made if m.startswith("more_")])
        more = let(added(kinds[0], lists, made), lambda x: F.struct(*[lists[m].alias(m) for m in made], x.alias(f"more_{kinds[0]}")))
        return let(more, lambda x: widened(x, [*made, f"more_{kinds[0]}"], kinds[1:]))

    first = F.struct(*[of_kind(base, k).alias(k) for k in KINDS])
    spans = let(first, lambda x: widened(x, list(KINDS), [k for k in KINDS if models[k].trees and models[k].threshold < 1]))
    order = F.transform(spans, lambda x: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), x["m"].alias("m")))
    sorted_ = F.transform(F.array_sort(order), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"))).cast(SPAN)
    return F.when(F.size(candidate) == 0, base).otherwise(sorted_)


def detect(docs: DataFrame, text: str = "text", precision: float = 0.9) -> DataFrame:
    """docs' other columns with base (validated spans) and spans (all of them), arrays of (kind, s, e, m) in code points, end exclusive.

    Texts are read once: the proposals go to the shared folder, the models are fitted on all of them, then spans
    are chosen. Null and empty texts have none, repeated rows are treated alike, an empty table gives an empty
    result, and columns that clash with a result are replaced.
    """
    keep = others(docs, text, "base", "spans")
    proposed = stash(proposals(docs, text, keep))
    models = learn(proposed, precision)
    return proposed.select(*from_row(keep), "base", chosen(F.col("base"), F.col("candidates"), models).alias("spans"))


def redact(docs: DataFrame, text: str = "text", precision: float = 0.9) -> DataFrame:
    """docs with each span in text replaced by its kind in brackets, as [EMAIL]; null stays null, whatever the other columns are called.

    Where spans overlap, the earlier one hides both. Each text is searched once: what was proposed is written beside the
    row to the shared folder, the models are fitted on it, and the texts are redacted from there.
    """
    proposed = stash(proposals(docs, text, docs.columns))
    models = learn(proposed, precision)
    whole = F.col("row").getField(text).cast("string")
    spans = F.when(whole.isNull(), none()).otherwise(chosen(F.col("base"), F.col("candidates"), models))
    out = proposed.select("row", whole.alias("whole"), spans.alias("spans")).select("row", F.when(F.col("whole").isNotNull(), hidden(F.col("whole"), F.col("spans"))).alias("new"))
    return out.select(*[F.col("new").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])


def report(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, numbers of base spans by kind, their digest, and all spans as one string."""
    out = detect(docs.select("doc_id", text), text)
    return out.select("doc_id", *[count(F.col("base"), k).alias(f"n_{k}") for k in KINDS], F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
