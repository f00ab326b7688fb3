"""Parsing of model replies: turns, judge labels, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parleyspark import config as C
from parleyspark.functions import text as T


def json_object(raw: Column) -> Column:
    """Text from the first '{' to the last '}', NULL if there is none."""
    found = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def _squeeze(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, C.SPACE_RUN, " "))


def _json_items(obj: Column, strict: bool = False) -> Column:
    """``turns`` or ``messages`` as strings; items may be objects with text or message.

    ``turns`` that is there but no list gives NULL. Strict takes ``turns`` only.
    """
    plain = F.from_json(obj, "struct<turns array<string>, messages array<string>>")
    listed = F.get_json_object(obj, "$.turns").isNull() | plain["turns"].isNotNull()
    items = plain["turns"] if strict else F.when(listed, F.coalesce(F.when(F.size(plain["turns"]) > 0, plain["turns"]), plain["messages"]))
    inner = lambda t: F.from_json(t, "struct<text string, message string>")
    nested = lambda t: F.coalesce(F.nullif(inner(t)["text"], F.lit("")), inner(t)["message"], F.lit(""))
    is_object = lambda t: F.startswith(F.ltrim(t), F.lit("{")) & F.get_json_object(t, "$").isNotNull()
    return F.transform(items, lambda t: F.when(is_object(t), nested(t)).otherwise(t))


def reply_turns(raw: Column, low: int = 3, high: int = 8) -> Column:
    """Turns of a chat reply: JSON list, else bullet lines; NULL out of range."""
    listed = F.filter(F.transform(_json_items(json_object(raw)), _squeeze), lambda t: t != "")
    bullet = r"^\s*(?:[-*]|\d+[.)]|[AB]:)\s*"
    lines = F.transform(
        F.split(T.strip(raw), r"\r\n|\n|\r"),
        lambda x: _squeeze(F.trim(T.strip(F.regexp_replace(x, bullet, "")), F.lit('"'))),
    )
    lines = F.filter(lines, lambda x: x != "")
    fits = lambda a: F.size(a).between(low, high)
    return F.when(fits(listed), listed).when(fits(lines), lines)


def strict_turns(raw: Column, k: Column, name_x: Column, name_y: Column) -> Column:
    """Exactly k turns of a thread reply; thinking, fences and speaker names removed."""
    body = T.strip(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""))
    body = T.strip(F.regexp_replace(body, r"(?m)^```(?:json)?|```$", ""))
    items = _json_items(json_object(body), strict=True)

    def tidy(t):
        t = T.strip_role(_squeeze(t))
        for name in (name_x, name_y):
            t = T.strip_name(t, name)
        return t

    out = F.transform(items, tidy)
    return F.when(F.size(out) == k, out)


def judge(raw: Column) -> Column:
    """struct<label, confidence, reason> of a judge reply, NULL if unusable."""
    obj = F.from_json(json_object(T.clean_reply(raw)), "struct<label string, confidence string, reason string>")
    label = obj["label"].try_cast("int")
    confidence = F.coalesce(obj["confidence"].try_cast("double"), F.when(obj["confidence"].isNull(), 0.5))
    usable = label.isin(0, 1) & confidence.isNotNull()
    reason = F.left(F.coalesce(obj["reason"], F.lit("")), F.lit(200))
    return F.when(usable, F.struct(label.alias("label"), confidence.alias("confidence"), reason.alias("reason")))


VERDICTS = ("PRESERVED", "SOFTENED", "UNRELATED")


def verdict(raw: Column) -> Column:
    """struct<verdict, confidence>: JSON field first, else keyword scan."""
    text = F.coalesce(raw, F.lit(""))
    obj = F.from_json(json_object(text), "struct<verdict string, confidence string>")
    named = F.upper(T.strip(obj["verdict"]))
    confidence = F.coalesce(obj["confidence"].try_cast("double"), F.when(obj["confidence"].isNull(), 0.5))
    keyword = F.lit(None).cast("string")
    for v in reversed(VERDICTS):
        keyword = F.when(F.contains(F.upper(text), F.lit(v)), v).otherwise(keyword)
    ok = named.isin(*VERDICTS) & confidence.isNotNull()
    found = F.when(ok, named).otherwise(keyword)
    score = F.when(ok, confidence).when(keyword.isNotNull(), 0.5).otherwise(0.0)
    return F.struct(found.alias("verdict"), score.alias("confidence"))
