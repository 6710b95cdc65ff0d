"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import GENERIC_DOMAINS, MAX_LEN

# A URL is a scheme with what follows, up to white space or a bracket and from there back to a letter, a digit or a sign that URLs end
# with; or a bare host under a generic domain or any of two letters (those of countries), with its path. Hosts beside an at sign belong to addresses and stay.
_REST = r"[^\s()<>{}\[\]]*[A-Za-z0-9/_=&#%~+-]"
SCHEME_URL = rf"https?:/{{1,3}}{_REST}"
HOST_URL = rf"(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+(?:{'|'.join(GENERIC_DOMAINS)}|[a-z]{{2}})\b(?:/(?:{_REST})?)?"
URL = rf"(?i)(?<![@a-z0-9.-])(?:{SCHEME_URL}|{HOST_URL}(?!@))"


def let(value: Column, body) -> Column:
    """Binds an expression to a lambda variable: computed once per row, also where body uses it inside further lambdas.

    Without it the optimizer may put a column's expression into a lambda, to be computed again for every element.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """White-space separated words; none for empty or null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def top_category(categories: Column) -> Column:
    """What stands before the first pipe, untrimmed."""
    return F.substring_index(categories, "|", 1)


def prompt_name(a: Column, b: Column | None, relation: Column) -> Column:
    """`a-b-relation`, or `a-relation` for one item; a null b counts as one item."""
    return F.concat_ws("-", a, relation) if b is None else F.concat_ws("-", a, b, relation)


def prompt_key(a: Column, b: Column | None, relation: Column) -> Column:
    return F.md5(prompt_name(a, b, relation))


def fill(template: Column, a: Column, b: Column | None = None) -> Column:
    """[A] and [B] replaced literally."""
    out = F.replace(template, F.lit("[A]"), a)
    return out if b is None else F.replace(out, F.lit("[B]"), b)


def from_template(assertion: Column, template: Column) -> Column:
    """The assertion from the first place of its template on; for the empty template, what follows "because ". Null where it is missing."""
    at = F.instr(assertion, template)
    cause = F.instr(assertion, F.lit("because "))
    rest = F.when(cause > 0, F.substring(assertion, cause + 8, F.length(assertion)))
    return F.when(template == "", rest).when(at > 0, F.substring(assertion, at, F.length(assertion)))


def cleaned(text: Column) -> Column:
    """For parsing: runs beyond ASCII to a blank, <ref...> within a line to <ref>, URLs to <url>, of which two with at most brackets between become one; without white space at the ends."""
    out = F.regexp_replace(text, r"[^\x00-\x7F]+", " ")
    out = F.regexp_replace(out, r"<ref[^>\n]*>", "<ref>")
    out = F.regexp_replace(out, URL, "<url>")
    out = F.regexp_replace(out, r"<url>[()\[\]]*<url>", "<url>")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def sentences(text: Column, max_len: int = MAX_LEN) -> Column:
    """text as it is up to max_len; else its paragraphs, of which long ones give lines, of which long ones give sentences. Blank pieces go."""

    def cut(pieces: Column, pattern: str) -> Column:
        return F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) <= max_len, F.array(p)).otherwise(F.split(p, pattern))))

    pieces = cut(cut(cut(F.array(F.coalesce(text, F.lit(""))), r"\n\n"), r"\n"), r"(?<=[.!?])\s+")
    return F.filter(F.transform(pieces, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def fuzzy_tag(tag: Column) -> Column:
    """NN*, RB* and JJ* to NN, RB and JJ."""
    return F.regexp_replace(tag, r"^(NN|RB|JJ).*", "$1")


def plain_label(label: Column) -> Column:
    """A dependency label without what follows its colon."""
    return F.split_part(label, F.lit(":"), F.lit(1))


def index_from(items: Column, item: Column, start: Column) -> Column:
    """The first 0-based place of item from start on; -1 if none."""
    at = F.array_position(F.slice(items, start + 1, F.greatest(F.size(items) - start, F.lit(0))), item)
    return F.when(at > 0, at + start - 1).otherwise(F.lit(-1)).cast("int")


def indices_from(items: Column, item: Column, start: int = 0) -> Column:
    """All 0-based places of item from start on."""
    return F.filter(F.transform(items, lambda x, i: F.when((x == item) & (i >= start), i)), lambda i: i.isNotNull())


def hyphened(concept: Column) -> Column:
    return F.replace(concept, F.lit(" "), F.lit("-"))


def node_parts(node: Column) -> Column:
    """The two items of a node key `a-b`; null unless there are exactly two."""
    parts = F.split(node, "-")
    return F.when(F.size(parts) == 2, parts)


def relation_of(sid: Column) -> Column:
    """The relation in a sentence id `a-relation-b|row`: the part before the last hyphen."""
    return F.element_at(F.split(sid, "-"), -2)


def named(text: Column, a: Column, b: Column) -> Column:
    """Item A and Item B replaced by their names."""
    return F.replace(F.replace(text, F.lit("Item A"), a), F.lit("Item B"), b)
