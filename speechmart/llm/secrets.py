"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong patterns (assignments to secret names, access ids, long hex strings) are reported as they
are. Weak parts (identifier-like words, secret-like words, endpoints) are common in clean text, so
they are only reported where complementary parts lie within one scope of ``SCOPE`` code points of a
document: a secret with an identifier or an endpoint. Parts are linked by an interval join: both
sides carry the scope's bucket as an equality key, the secrets also the two buckets beside it.

Positions are found natively: the text between matches (``split``) and the matches themselves have
known lengths, and their running sum, taken block by block, gives every start with linear work. Texts
never take part in a shuffle, but for those of ``redact`` whose weak parts have to be linked.

Null counts as an empty text and has no spans; texts are read whole, however many matches one has;
repeated rows give a row each; an empty table gives an empty result; columns other than the two named
are not read (``redact`` passes them on).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick

SCOPE = 400
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Weak parts: words that are credentials only in company.
WEAK_ID = r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{16,24}(?![A-Za-z0-9])"
WEAK_SECRET = r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"(?:https?|s3|ftp|ssh|amqps?|redis|mongodb|mysql|postgres(?:ql)?)://[A-Za-z0-9._~:/?#@%&=+-]+"

#: What a text holds if it holds a match at all, where that is found faster: strings, in any case or as they are, or a shorter pattern.
NAMES, ANCHORS = ("password", "passwd", "secret", "token", "api"), {"access": "AKIA", "endpoint": "://"}
SIGNS = {"id": r"(?<![A-Za-z0-9])[A-Z0-9]{16}", "secret": r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}"}

ORDER = {"assign": 1, "access": 2, "hex": 3, "id": 4, "secret": 5, "endpoint": 6}
SECRETS = ("secret", "assign", "hex")
SPAN = "array<struct<start:int,ord:int,kind:string,end:int>>"


_BLOCK = 256


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For every value the ``op`` (with 0) of all values before it, block by block."""
    none = F.array().cast("array<int>")

    def fold(items: Column, value: Callable[[Column], Column], sent: Callable[[Column, Column], Column]) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(items, start, lambda s, x: F.struct(op(s["at"], value(x)).alias("at"), F.array_append(s["out"], sent(s, x)).alias("out")))

    blocks = F.transform(F.sequence(F.lit(1), F.size(values), F.lit(_BLOCK)), lambda k: fold(F.slice(values, k, _BLOCK), lambda x: x, lambda s, x: s["at"]))
    merged = _bind(blocks, lambda bs: F.flatten(F.zip_with(bs, fold(bs, lambda b: b["at"], lambda s, b: s["at"])["out"], lambda b, k: F.transform(b["out"], lambda x: op(x, k)))))
    return F.when(F.size(values) > 0, merged).otherwise(none)


def _located(text: Column, matches: Column, pattern: str, kind: str, has_value: bool) -> Column:
    """Spans of the matches, from the lengths of the texts between them; a value is group 2 and has 8 characters at least."""
    empty = F.array().cast(SPAN)
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(matches)).alias("g"), matches.alias("m"))

    def spans(pairs: Column) -> Column:
        before = _running(F.transform(pairs, lambda p: F.length(p["g"]) + F.length(p["m"])), lambda x, y: x + y)
        whole = F.zip_with(
            pairs,
            before,
            lambda p, k: F.struct(
                (k + F.length(p["g"])).alias("start"),
                F.lit(ORDER[kind]).alias("ord"),
                F.lit(kind).alias("kind"),
                (k + F.length(p["g"]) + F.length(p["m"])).alias("end"),
                p["m"].alias("m"),
            ),
        )
        held = whole if not has_value else F.filter(whole, lambda s: F.length(F.regexp_extract(s["m"], pattern, 2)) >= 8)
        return F.transform(held, lambda s: F.struct(*[s[n].alias(n) for n in ("start", "ord", "kind", "end")]))

    return F.when(F.size(matches) > 0, _bind(pairs, spans)).otherwise(empty)


def parts_of(text: Column) -> tuple[Column, Column]:
    """Base spans and weak spans of a text without nulls."""
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "id": WEAK_ID, "secret": WEAK_SECRET, "endpoint": ENDPOINT}

    def may_hold(kind: str) -> Column:
        """False for most texts without a match; true for all with one."""
        if kind == "assign":
            return _bind(F.lower(text), lambda low: functools.reduce(Column.__or__, [F.contains(low, F.lit(n)) for n in NAMES]))
        if kind in ANCHORS:
            return F.contains(text, F.lit(ANCHORS[kind]))
        return text.rlike(SIGNS[kind]) if kind in SIGNS else F.lit(True)

    def spans_of(kind: str) -> Column:
        p = patterns[kind]
        found = _bind(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda m: _located(text, m, p, kind, kind == "assign"))
        return F.when(may_hold(kind), found).otherwise(F.array().cast(SPAN))

    spans = {k: spans_of(k) for k in patterns}
    return F.array_sort(F.concat(spans["assign"], spans["access"], spans["hex"])), F.concat(spans["id"], spans["secret"], spans["endpoint"])


def _has_both() -> Column:
    """Whether a row with ``base`` and ``weak`` holds a secret and a complement at all, one of them weak."""
    parts = F.concat("base", "weak")
    return (F.size("weak") > 0) & F.exists(parts, lambda p: p["kind"].isin(*SECRETS)) & F.exists(parts, lambda p: ~p["kind"].isin(*SECRETS))


def link_parts(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak spans with a complementary part in scope: _rid and their array ``linked``.

    ``rows`` has _rid, base and weak. Secrets are weak secrets and the strong assign and hex spans;
    complements are weak ids, endpoints and strong access ids.
    """
    is_secret = F.col("p.kind").isin(*SECRETS)
    part = (
        rows.filter(_has_both())
        .select("_rid", F.explode(F.concat("base", "weak")).alias("p"))
        .select("_rid", "p", is_secret.alias("is_secret"), F.floor(F.col("p.start") / scope).alias("b"))
    )
    left = part.filter("is_secret").select("_rid", F.col("p").alias("s"), F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"))
    right = part.filter("not is_secret").select("_rid", F.col("p").alias("c"), "b")
    near = (F.col("c.start") - F.col("s.start")).between(-scope, scope) & ((F.col("c.end") <= F.col("s.start")) | (F.col("s.end") <= F.col("c.start")))
    pairs = left.join(right, ["_rid", "b"]).filter(near)
    hits = pairs.select("_rid", F.explode(F.array("s", "c")).alias("p")).filter(F.col("p.ord") > 3)
    return hits.groupBy("_rid").agg(F.array_sort(F.collect_set("p")).alias("linked"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans, n_linked, span_list."""
    d = pick(docs, [id_col, text_col]).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    base, weak = parts_of(F.col("_t"))
    rows = d.select("_id", base.alias("base"), weak.alias("weak"), F.monotonically_increasing_id().alias("_rid"))
    rows = materialize(rows, "secret-parts")
    linked = F.coalesce(F.col("linked"), F.array().cast(SPAN))
    count = [_count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    whole = rows.join(link_parts(rows, scope), "_rid", "left")
    return whole.select(
        F.col("_id").alias(id_col),
        *count,
        F.sha2(F.encode(_joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", linked))).alias("spans"),
        F.size(linked).cast("long").alias("n_linked"),
        F.array_sort(F.concat("base", linked)).alias("span_list"),
    )


def _masked(text: Column, spans: Column, mark: str) -> Column:
    """The text with every group of overlapping spans (in order of start) replaced by one mark."""
    before = _running(F.transform(spans, lambda s: s["end"]), F.greatest)
    cuts = F.filter(F.arrays_zip(spans.alias("s"), before.alias("b")), lambda c: c["s"]["start"] >= c["b"])
    pieces = F.transform(cuts, lambda c: F.substring(text, c["b"] + 1, c["s"]["start"] - c["b"]))
    tail = F.substring(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text))
    return F.array_join(F.concat(pieces, F.array(tail)), mark)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", scope: int = SCOPE, length_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` with every found span replaced by ``mark``; rows without spans are unchanged.

    Overlapping spans become one mark. ``length_col`` is set anew where the text changes. Every row
    comes back, repeated ones and those with null ids or texts too; all other columns are passed on.
    Rows are written once with their spans; only those that hold a secret and a complement, one of them
    weak, go through the join that links them.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    base, weak = parts_of(F.col("_t"))
    rows = docs.select(whole.alias("_row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"))
    rows = materialize(rows.select("_row", base.alias("base"), weak.alias("weak"), F.monotonically_increasing_id().alias("_rid")), "secret-rows")
    linked = link_parts(rows.select("_rid", "base", "weak"), scope)
    weak_rows = rows.filter(_has_both()).join(linked, "_rid", "left")
    spans = F.when(F.col("linked").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "linked")))
    every = rows.filter(~_has_both()).select("_row", F.col("base").alias("spans")).unionAll(weak_rows.select("_row", spans.alias("spans")))
    text = F.col("_row")[text_col]
    out = every.select("_row", F.when(F.size("spans") > 0, _masked(text, F.col("spans"), mark)).otherwise(text).alias("_text"))
    changed = {text_col: F.col("_text")}
    if length_col:
        length = F.when(F.col("_text").eqNullSafe(text), F.col("_row")[length_col]).otherwise(F.length("_text"))
        changed[length_col] = length.cast(docs.schema[length_col].dataType)
    return out.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
