"""Fixed values that results depend on: relations with their texts, tag sets, word sets. Stated as they must be, in natural order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Relation, parse template, part-of-speech prefix, prompt for two items, prompt for one item.
RELATIONS: tuple[tuple[str, str, str, str, str], ...] = (
    ("open", "", "", "because", "because"),
    ("relatedTo", "they both are related to", "PRP DT VBP JJ TO", "because they both are related to", "because the product is related to"),
    ("isA", "they both are a type of", "PRP DT VBP DT NN IN", "because they both are a type of", "because the product is a type of"),
    ("partOf", "they both are a part of", "PRP DT VBP DT NN IN", "because they both are a part of", "because the product is a part of"),
    ("madeOf", "they both are made of", "PRP DT VBP VBN IN", "because they both are made of", "because the product is made of"),
    ("similarTo", "they both are similar to", "PRP DT VBP JJ TO", "because they both are similar to", "because the product is similar to"),
    ("createdBy", "they are created by", "PRP VBP VBN IN", "because they are created by", "because the product is created by"),
    ("hasA", "they both have", "PRP DT VBP", "because they both have", "because the product has"),
    ("propertyOf", "they both have a property of", "PRP DT VBP DT NN IN", "because they both have a property of", "because the product has a property of"),
    ("distinctFrom", "they are distinct from", "PRP VBP JJ IN", "because they are distinct from", "because the product is distinct from"),
    ("usedFor", "they are both used for", "PRP VBP DT VBN IN", "because they are both used for", "because the product is used for"),
    ("can", "they could both", "PRP MD CC", "because they could both", "because the product could"),
    ("capableOf", "they both are capable of", "PRP DT VBP JJ IN", "because they both are capable of", "because the product is capable of"),
    ("definedAs", "they both are defined as", "PRP DT VBP VBN IN", "because they both are defined as", "because the product is defined as"),
    ("symbolOf", "they both are symbols of", "PRP DT VBP NNS IN", "because they both are symbols of", "because the product is symbols of"),
    ("mannerOf", "they both are a manner of", "PRP DT VBP DT NN IN", "because they both are a manner of", "because the product is a manner of"),
    ("deriveFrom", "they are derived from", "PRP VBP VBN IN", "because they are derived from", "because the product is derived from"),
    ("effect", "the person will", "DT NN MD", "as a result, the person will", "as a result, the person will"),
    ("cause", "the person wants to", "DT NN VBZ TO", "because the person wants to", "because the person wants to"),
    ("motivatedBy", "buying them was motivated by", "VBG PRP VBD VBN IN", "and buying them was motivated by", "and buying them was motivated by"),
    ("causeEffect", "the person wants his", "DT NN VBZ PRP$", "because the person wants his", "because the person wants his"),
)
#: A spelling that inputs may carry, read as the relation it stands for.
ALIASES = {"propertOf": "propertyOf"}
SINGLE_PREDICATE = 'He bought a product of "[A]" '
PAIR_PREDICATE = 'He bought a product of "[A]" and a product of "[B]" '

# Tag sets.
MUST_POS_TAGS = ("IN", "CC", "TO")
OPTIONAL_POS_TAGS = ("JJ", "JJR", "JJS", "RB", "RBR", "RBS", "DT", "PRP$")
IGNORE_POS_TAGS = (".", ",", "``", "''", ":", "$", "(", ")", "#", "-LRB-", "-RRB-")
FORBIDDEN_END_POS_TAGS = ("IN", "CC", "TO")
#: Tags that separate clauses, and what those begin with that do so too.
CLAUSE_SEPARATOR_TAGS = ("WRB", ";", ".", "?", "!")
CLAUSE_SEPARATOR_PREFIX = "WP"

# Entity types of mentions, and words.
MENTION_TYPES = ("CITY", "ORGANIZATION", "COUNTRY", "STATE_OR_PROVINCE", "LOCATION", "NATIONALITY", "PERSON")
PRONOUNS = (
    "i", "I", "me", "my", "mine", "myself", "we", "us", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themself", "themselves",
)
PUNCTUATION = tuple("""!"#&'*+,-./:;<=>?@[\\]^_`|~""") + ("``", "''")
SEED_NERS = ("TIME", "DATE", "DURATION", "MONEY", "PERCENT", "NUMBER", "COUNTRY", "STATE_OR_PROVINCE", "CITY", "NATIONALITY", "PERSON", "RELIGION", "URL")
PERSON_PRONOUNS = ("he", "she", "i", "him", "her", "me", "woman", "man", "boy", "girl", "you", "we", "they")
MAX_LEN = 1024


def relations(spark: SparkSession) -> DataFrame:
    """The relation dimension: 21 rows, whatever the data."""
    return spark.createDataFrame(list(RELATIONS), "relation string, template string, pos_prefix string, pair_prompt string, single_prompt string")


def relations_sql(alias: str = "relations") -> str:
    """The same as a common table expression."""
    rows = ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in RELATIONS)
    return f"{alias}(relation, template, pos_prefix, pair_prompt, single_prompt) AS (VALUES {rows})"

#: The generic domains that a bare host may be under.
GENERIC_DOMAINS = (
    "com", "net", "org", "edu", "gov", "mil", "aero", "asia", "biz", "cat", "coop", "info", "int", "jobs", "mobi", "museum", "name", "post", "pro", "tel", "travel", "xxx",
)
