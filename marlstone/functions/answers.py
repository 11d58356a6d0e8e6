"""Answers of models and messages of users, read as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import confidence_tier, strip, strip_code_fence

# Categories, intents, where an intent goes and which ticket it makes, attempts before a question is passed on.
CATEGORIES = ["GREETING", "OUT_OF_SCOPE", "DOMAIN_REQUEST"]
INTENTS = ["KNOWLEDGE_QUERY", "CREATE_TICKET", "CHECK_TICKET_STATUS", "UNKNOWN"]
AGENT_OF = {"KNOWLEDGE_QUERY": "knowledge_agent", "CREATE_TICKET": "ticket_agent", "CHECK_TICKET_STATUS": "ticket_status_agent"}
MOST_CLARIFICATIONS = 3
# Words that cancel.
CANCEL = ["cancel", "never mind", "nevermind", "stop"]
#: An address by form alone, and the most characters before its `@`.
_LABEL = "[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?"
EMAIL = rf"^[A-Za-z0-9!#$%&'*+/=?^_`{{|}}~-]+(\.[A-Za-z0-9!#$%&'*+/=?^_`{{|}}~-]+)*@({_LABEL}\.)+[A-Za-z]{{2,}}$"
MOST_LOCAL = 64


def parse_classification(text: Column) -> Column:
    """(category, intent, confidence) of a JSON answer. Whatever is no JSON object, or not known, gives OUT_OF_SCOPE,
    UNKNOWN and 0; a confidence is clamped to 0..1.
    """
    field = lambda p: F.get_json_object(text, f"$.{p}")
    known = lambda x, names, other: F.when(x.isin(*names), x).otherwise(other)
    number = F.coalesce(field("intent_confidence").try_cast("double"), F.lit(0.0))
    return F.struct(known(field("request_category"), CATEGORIES, "OUT_OF_SCOPE").alias("category"), known(field("intent"), INTENTS, "UNKNOWN").alias("intent"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)).alias("confidence"))


def decide_route(category: Column, intent: Column, confidence: Column, attempts: Column) -> Column:
    """(next_agent, ticket_type, clarify, attempts): where a classified message goes. Only requests of the domain go to an
    agent: a status question always, an unknown intent after MOST_CLARIFICATIONS as an escalation, and others if their
    confidence is high; else the user is asked.
    """
    unknown = intent == "UNKNOWN"
    case = (
        F.when(category != "DOMAIN_REQUEST", "end").when(intent == "CHECK_TICKET_STATUS", "status").when(unknown & (attempts + 1 >= MOST_CLARIFICATIONS), "escalate")
        .when(unknown | (confidence_tier(confidence) != "HIGH"), "clarify").otherwise("route")
    )
    agents = F.create_map(*(F.lit(x) for kv in AGENT_OF.items() for x in kv))
    agent = F.when(case == "escalate", "ticket_agent").when(case == "status", "ticket_status_agent").when(case == "route", F.coalesce(F.try_element_at(agents, intent), F.lit("ticket_agent"))).otherwise("none")
    ticket = F.when(case == "escalate", "escalation").when((case == "route") & (intent == "CREATE_TICKET"), "standard")
    return F.struct(agent.alias("next_agent"), ticket.alias("ticket_type"), (case == "clarify").alias("clarify"), F.when(case.isin("escalate", "clarify"), attempts + 1).otherwise(0).alias("attempts"))


def parse_query(text: Column) -> Column:
    """(entity_type, entity_label, attribute, filters, confidence, valid) of a JSON answer, which may be fenced. Blank
    strings are null; filters are an array of (field, value), where one object counts as an array of one and entries
    without both as nothing. Not valid: no JSON object, or a confidence that is no number from 0 to 1. Filters are kept
    for the caller; no lookup reads them.
    """
    body = strip_code_fence(text)
    blank = lambda p: F.nullif(F.trim(F.get_json_object(body, f"$.{p}")), F.lit(""))
    raw = F.get_json_object(body, "$.filters")
    listed = F.when(raw.startswith("{"), F.concat(F.lit("["), raw, F.lit("]"))).when(raw.startswith("["), raw)
    filters = F.filter(F.from_json(listed, "array<struct<field: string, value: string>>"), lambda f: f["field"].isNotNull() & f["value"].isNotNull())
    given = F.get_json_object(body, "$.confidence")
    number = F.coalesce(given.try_cast("double"), F.when(given.isNull(), 0.0))
    is_object = F.coalesce(F.get_json_object(body, "$").startswith("{"), F.lit(False))
    valid = is_object & F.coalesce(number.between(0.0, 1.0), F.lit(False))
    return F.struct(
        blank("entity_type").alias("entity_type"), blank("entity_label").alias("entity_label"), blank("attribute").alias("attribute"),
        F.coalesce(filters, F.array().cast("array<struct<field: string, value: string>>")).alias("filters"), F.when(valid, number).alias("confidence"), valid.alias("valid"),
    )


def _typed(text: Column) -> tuple[Column, dict]:
    """A JSON answer, which may be fenced, as a variant, and of a path its type (null where it is missing) and its value."""
    v = F.try_parse_json(strip_code_fence(text))
    kind = lambda p: F.schema_of_variant(F.try_variant_get(v, p, "variant"))
    return v, kind


def _text_of(v: Column, kind, path: str) -> Column:
    """A string that is not blank, without white space at its ends; else null."""
    return F.when(kind(path) == "STRING", F.nullif(strip(F.try_variant_get(v, path, "string")), F.lit("")))


def _list_of(v: Column, kind, path: str, json_type: str, spark_type: str) -> Column:
    """A list of one type without nulls; the empty list where there is none; null for anything else."""
    empty, listed = F.array().cast(f"array<{spark_type}>"), F.try_variant_get(v, path, f"array<{spark_type}>")
    k = F.coalesce(kind(path), F.lit("missing"))
    whole = F.when(k.isin(f"ARRAY<{json_type}>", "ARRAY<VOID>") & ~F.exists(listed, lambda x: x.isNull()), listed)
    return F.when(k == "missing", empty).otherwise(whole)


def parse_rewrite(text: Column) -> Column:
    """(rewritten_text, resolved_references) of a JSON answer. Null: no JSON object, no text that is not blank, or
    references that are no list of strings.
    """
    v, kind = _typed(text)
    rewritten, references = _text_of(v, kind, "$.rewritten_text"), _list_of(v, kind, "$.resolved_references", "STRING", "string")
    return F.when(rewritten.isNotNull() & references.isNotNull(), F.struct(rewritten.alias("rewritten_text"), references.alias("resolved_references")))


def parse_answer(text: Column) -> Column:
    """(answer, is_grounded, citation_indices) of a JSON answer. Null: no JSON object, no answer that is not blank,
    is_grounded that is no boolean, or indices that are no list of whole numbers.
    """
    v, kind = _typed(text)
    answer, indices = _text_of(v, kind, "$.answer"), _list_of(v, kind, "$.citation_indices", "BIGINT", "bigint")
    grounded = F.when(kind("$.is_grounded") == "BOOLEAN", F.try_variant_get(v, "$.is_grounded", "boolean"))
    return F.when(answer.isNotNull() & grounded.isNotNull() & indices.isNotNull(), F.struct(answer.alias("answer"), grounded.alias("is_grounded"), indices.alias("citation_indices")))


def strategy(entity_type: Column) -> Column:
    """How a parsed query is answered: by facts and passages if it names a type of entity, else by passages."""
    return F.when(entity_type.isNotNull(), "hybrid").otherwise("vector")


def cancels(text: Column) -> Column:
    """Does a message call the dialogue off? Not if it holds an `@`, as then it is an address."""
    low = F.lower(text)
    return ~F.contains(low, F.lit("@")) & F.exists(F.array(*map(F.lit, CANCEL)), lambda c: F.contains(low, c))


def email(text: Column) -> Column:
    """The address a message consists of, without white space and with its domain in lower case; null if it is none.
    Checked by form alone: no dot at an end or twice, a domain of labels, a top level of letters.
    """
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    good = trimmed.rlike(EMAIL) & (F.length(F.split_part(trimmed, F.lit("@"), F.lit(1))) <= MOST_LOCAL)
    return F.when(good, F.concat(F.split_part(trimmed, F.lit("@"), F.lit(1)), F.lit("@"), F.lower(F.split_part(trimmed, F.lit("@"), F.lit(2)))))


# Networks of version 4 by what they are for; the first that holds an address names it.
NETWORKS = [
    ("127.0.0.0", 8, "loopback"), ("169.254.0.0", 16, "link-local"), ("0.0.0.0", 32, "unspecified"), ("224.0.0.0", 4, "multicast"), ("240.0.0.0", 4, "reserved"),
    ("0.0.0.0", 8, "private"), ("10.0.0.0", 8, "private"), ("172.16.0.0", 12, "private"), ("192.168.0.0", 16, "private"), ("192.0.0.0", 29, "private"), ("192.0.0.170", 31, "private"),
    ("192.0.2.0", 24, "private"), ("198.18.0.0", 15, "private"), ("198.51.100.0", 24, "private"), ("203.0.113.0", 24, "private"), ("100.64.0.0", 10, "not globally routable"),
]


def _number(address: str) -> int:
    out = 0
    for part in address.split("."):
        out = out * 256 + int(part)
    return out


def unsafe_address(address: Column) -> Column:
    """Why a crawler must not fetch from an address: loopback, link-local, unspecified, multicast, reserved, private or not
    globally routable; `not an address`; null if it may. Version 4 addresses by their networks, also where version 6
    carries them (::ffff:1.2.3.4); of version 6 only 2000::/3 without the documentation network may be fetched.
    """
    low = F.lower(F.trim(address))
    four = F.regexp_extract(low, r"^(?:::ffff:)?(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})$", 1)
    parts = F.transform(F.split(four, r"\."), lambda p: p.try_cast("long"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p)
    is_four = (four != "") & F.forall(parts, lambda p: p <= 255)
    why = F.lit(None).cast("string")
    for start, bits, name in reversed(NETWORKS):
        why = F.when(F.shiftright(number, 32 - bits) == _number(start) >> (32 - bits), name).otherwise(why)
    six = low.rlike(r"^(?=.*:)[0-9a-f:]+$") & ~low.rlike(r":::|::.*::") & (low.contains("::") | low.rlike(r"^([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$"))
    of_six = (
        F.when(low.rlike(r"^(0*:)*:?(0*:)*0*1$"), "loopback").when(low.rlike(r"^[0:]+$"), "unspecified").when(low.rlike(r"^fe[89ab][0-9a-f]:"), "link-local").when(low.rlike(r"^ff[0-9a-f]{2}:"), "multicast")
        .when(low.rlike(r"^f[cd][0-9a-f]{2}:") | low.rlike(r"^2001:0?db8:"), "private").when(~low.rlike(r"^[23][0-9a-f]{3}:"), "not globally routable")
    )
    return F.when(is_four, why).when(six, of_six).otherwise("not an address")
