"""Mixing sources to target weights by iterative proportional fitting.

The token counts of the cells (source, language, topic) are raked: in turn, the
cells of each source, each language and each topic are scaled so that their sum
is that value's target. Every document of a cell is then kept with probability
min(1, scale * raked / present), where the scale makes the expected tokens equal
the budget. A document's draw is a hash of its id, so it never changes.

Only DataFrame functions run: one pre-aggregated pass over the documents makes
the cell table, whose size is the number of combinations present; the rounds
work on that table. Scalars alone reach the driver.

Topics, where ``topic`` is no column, follow the rules in ``TOPICS``: the first
pattern found in the text, else ``prose``.

Targets: ``targets[column][value]`` are shares; values without one share what is
left in proportion to tokens ** ``temper``. Default: that rule alone.

Defined results: null source, lang or topic is the value ``(none)``; null and empty
texts have no tokens and probability 0; a row with a null id is drawn as id
"null"; repeated rows share one draw; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# Topics and the patterns that assign them, in order.
TOPICS = {
    "licence": r"(?i)licen[cs]e|copyright|all rights reserved",
    "contact": r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]|https?://",
    "table": r" \| [^\n]* \| ",
    "symbols": r"[#$%&*]{3}",
}
DIMENSIONS = ("source", "lang", "topic")
NONE = "(none)"
BUDGET, TEMPER, ROUNDS, SCALE_ROUNDS = 0.5, 0.7, 8, 6
#: Places of the id's md5 that make the draw.
DIGITS = 12


def topic_of(text: Column) -> Column:
    out = None
    for name, pattern in TOPICS.items():
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise("prose")


def tokens_of(text: Column) -> Column:
    """Words separated by white space (ASCII)."""
    clean = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(clean == "", F.lit(0)).otherwise(F.size(F.split(clean, " +"))).cast("long")


def draw_of(doc_id: Column) -> Column:
    """A number in [0, 1) from the id alone."""
    text = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def cell_of(docs: DataFrame) -> dict[str, Column]:
    """A row's source, language and topic, none of them null."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    return {"source": value("source"), "lang": value("lang"), "topic": value("topic") if "topic" in docs.columns else topic_of(F.coalesce(F.col("text"), F.lit("")))}


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens`` of each row."""
    return docs.select("doc_id", *[c.alias(n) for n, c in cell_of(docs).items()], tokens_of(F.col("text")).alias("n_tokens"))


def _targets(cells: DataFrame, column: str, given: dict[str, float], temper: float) -> DataFrame:
    """``column, target`` with shares that sum to one."""
    sums = cells.groupBy(column).agg(F.sum("present").alias("m"))
    fixed = F.coalesce(*[F.when(F.col(column) == k, F.lit(float(v))) for k, v in given.items()], F.lit(None).cast("double")) if given else F.lit(None).cast("double")
    sums = sums.select(column, fixed.alias("fixed"), F.pow("m", F.lit(temper)).alias("free"))
    total = sums.agg(F.sum("fixed"), F.sum(F.when(F.col("fixed").isNull(), F.col("free")))).first()
    named, free = float(total[0] or 0.0), float(total[1] or 0.0)
    rest = max(0.0, 1.0 - named)
    part = F.when(F.col("fixed").isNotNull(), F.col("fixed") / F.lit(max(named, 1.0) if free else named or 1.0)).otherwise(F.col("free") * F.lit(rest / free if free else 0.0))
    return sums.select(column, part.alias("target"))


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, *, temper: float = TEMPER, rounds: int = ROUNDS) -> DataFrame:
    """``source, lang, topic, present, raked`` of ``cells(source, lang, topic, present)``; ``raked`` sums to one."""
    aims = {c: common.save(_targets(cells, c, (targets or {}).get(c, {}), temper), f"target_{c}") for c in DIMENSIONS}
    total = cells.agg(F.sum("present")).first()[0] or 1
    now = cells.withColumn("raked", F.col("present") / F.lit(float(total)))
    for _ in range(rounds):
        for c in DIMENSIONS:
            factor = now.groupBy(c).agg(F.sum("raked").alias("m")).join(aims[c], c).select(c, (F.col("target") / F.col("m")).alias("factor"))
            now = now.join(factor, c).select(*DIMENSIONS, "present", (F.col("raked") * F.col("factor")).alias("raked"))
        now = common.save(now, "raked")
    return now


def residuals(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, *, temper: float = TEMPER) -> DataFrame:
    """``dimension, residual``: how far the marginals of ``rake``'s result are from their targets at most."""
    out = None
    for c in DIMENSIONS:
        far = F.max(F.abs(F.col("m") - F.col("target")))
        one = cells.groupBy(c).agg(F.sum("raked").alias("m")).join(_targets(cells, c, (targets or {}).get(c, {}), temper), c).agg(far.alias("residual")).select(F.lit(c).alias("dimension"), "residual")
        out = one if out is None else out.unionByName(one)
    return out


def rates(cells: DataFrame, budget: float, *, rounds: int = SCALE_ROUNDS) -> DataFrame:
    """``source, lang, topic, weight, probability`` of raked cells, for a share ``budget`` of all tokens."""
    total = float(cells.agg(F.sum("present")).first()[0] or 0)
    scale = budget * total
    for _ in range(rounds):  # cells at probability one give their excess to the others
        full = F.lit(scale) * F.col("raked") >= F.col("present")
        got = cells.agg(F.sum(F.when(full, F.col("present"))), F.sum(F.when(~full, F.col("raked")))).first()
        if got[1]:
            scale = max(0.0, budget * total - float(got[0] or 0)) / float(got[1])
    weight = F.when(F.col("present") > 0, F.col("raked") * F.lit(total) / F.col("present")).otherwise(F.lit(0.0))
    return cells.select(*DIMENSIONS, weight.alias("weight"), F.when(F.col("present") > 0, F.least(F.lit(1.0), F.lit(scale) * F.col("raked") / F.col("present"))).otherwise(F.lit(0.0)).alias("probability"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, *, budget: float = BUDGET, temper: float = TEMPER, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, weight, probability, sampled`` of each row of ``docs(doc_id, text, source, lang)``."""
    rows = common.save(described(docs), "described")
    cells = common.save(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("present")).where("present > 0"), "cells")
    rate = common.save(rates(rake(cells, targets, temper=temper, rounds=rounds), budget), "rates")
    out = rows.join(rate, [*DIMENSIONS], "left")
    zero = F.lit(0.0)
    p = F.when(F.col("n_tokens") > 0, F.coalesce("probability", zero)).otherwise(zero)
    return out.select("doc_id", *DIMENSIONS, "n_tokens", F.coalesce("weight", zero).alias("weight"), p.alias("probability"), (draw_of(F.col("doc_id")) < p).alias("sampled"))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, **how) -> DataFrame:
    """The sampled rows of ``docs``, all columns; rows of one id stay or go together."""
    budget, temper, rounds = how.get("budget", BUDGET), how.get("temper", TEMPER), how.get("rounds", ROUNDS)
    rows = described(docs)
    cells = common.save(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("present")).where("present > 0"), "cells")
    rate = common.save(rates(rake(cells, targets, temper=temper, rounds=rounds), budget), "rates").select(*[F.col(c).alias(f"__{c}") for c in DIMENSIONS], F.col("probability").alias("__probability"))
    keyed = docs.select("*", *[c.alias(f"__{n}") for n, c in cell_of(docs).items()])
    return keyed.join(rate, [f"__{c}" for c in DIMENSIONS]).where(draw_of(F.col("doc_id")) < F.col("__probability")).where(tokens_of(F.col("text")) > 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle(budget: float = BUDGET, temper: float = TEMPER, rounds: int = ROUNDS, digits: int = 6) -> str:
    """The same in DuckDB's SQL, the rounds written out."""
    topic = "case " + " ".join(f"when regexp_matches(coalesce(text, ''), '{p.replace(chr(39), chr(39) * 2)}') then '{n}'" for n, p in TOPICS.items()) + " else 'prose' end"
    clean = "trim(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '))"
    parts = [
        f"d as (select doc_id, coalesce(source, '{NONE}') source, coalesce(lang, '{NONE}') lang, {topic} topic, case when {clean} = '' then 0 else len(regexp_split_to_array({clean}, ' +')) end::bigint n_tokens from documents)",
        "r0 as (select source, lang, topic, sum(n_tokens)::double present, sum(n_tokens)::double / sum(sum(n_tokens)) over () raked from d group by all having sum(n_tokens) > 0)",
    ]
    for c in DIMENSIONS:
        parts.append(f"t_{c} as (select {c}, pow(sum(present), {temper}) / sum(pow(sum(present), {temper})) over () target from r0 group by {c})")
    at = "r0"
    for i in range(rounds):
        for c in DIMENSIONS:
            to = f"r{i + 1}_{c}"
            parts.append(f"{to} as materialized (select source, lang, topic, present, raked * target / sum(raked) over (partition by {c}) raked from {at} join t_{c} using ({c}))")
            at = to
    parts.append(f"s0 as (select {budget} * sum(present) scale from {at})")
    for i in range(SCALE_ROUNDS):
        full = "scale * raked >= present"
        parts.append(f"s{i + 1} as (select coalesce(greatest(0, {budget} * sum(present) - coalesce(sum(present) filter ({full}), 0)) / nullif(sum(raked) filter (not ({full})), 0), any_value(scale)) scale from {at}, s{i})")
    parts.append(f"p as (select source, lang, topic, raked * (select sum(present) from {at}) / present weight, least(1.0, scale * raked / present) probability from {at}, s{SCALE_ROUNDS})")
    u = f"('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, {DIGITS}))::bigint / {float(16**DIGITS)!r}"
    q = "case when n_tokens > 0 then coalesce(probability, 0) else 0 end"
    return f"with {', '.join(parts)} select doc_id, d.source, d.lang, d.topic, n_tokens, round(coalesce(weight, 0), {digits}) weight, round({q}, {digits}) probability, {u} < {q} sampled from d left join p using (source, lang, topic)"
