"""Secret scanning over content-addressed versions.

Every version of every path is addressed by the SHA-256 of its text. A ledger holds what each (blob, rule, version of the
rule) has given; only pairs that are not in it are scanned, one text per blob, with built-in regular expression
functions. Findings are joined back to all paths that ever held the blob.

Positions count code points, ends are exclusive. Nulls and edges: a null text is the empty blob; repeated rows of a
path give repeated rows; null paths are kept; id columns of any name but blob and found, which raise; an empty table gives
an empty table and adds nothing to the ledger.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latentlake.llm.text import let, written
from latentlake.plans.runtime import broadcast_if_small

FOUND = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
LEDGER = "blob string, rule string, version int, found array<struct<start: bigint, end: bigint>>"


@dataclass(frozen=True)
class Rule:
    """All leftmost matches of ``pattern`` that do not overlap; those whose ``group`` is shorter than ``least`` are dropped.

    ``hint`` is a pattern that is cheaper and matches wherever ``pattern`` does with enough characters.
    """

    name: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0
    hint: str | None = None


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + any_case("api") + "_?" + any_case("key")
ASSIGN = rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    Rule("assign", 1, ASSIGN, 6, 2),
    Rule("access", 1, "AKIA[A-Z0-9]+", 20, 0, "AKIA"),
    Rule("hex", 1, "[0-9a-f]+", 24, 0, "[0-9a-f]{24}"),
)
MORE = (
    Rule("private_key", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30, 0, "eyJ"),
    Rule("url_login", 1, r"[a-z]+://[A-Za-z0-9._-]+:[^\x20\x09-\x0D@/]+@", hint="://"),
)
RULES = BASE + MORE


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of a rule's matches: the lengths of what lies between matches give their places."""
    pattern = rule.pattern
    if rule.least and rule.group == 0 and pattern.endswith("+") and pattern.count("[") == 1:
        fixed = pattern.index("[")  # a maximal run: asking for its length in the pattern finds the same runs
        pattern = f"{pattern[:-1]}{{{rule.least - fixed},}}"
    p = F.lit(pattern)

    def located(parts):
        def step(acc, m):
            start = acc["at"] + F.length(F.get(parts, acc["k"])).cast("long")
            end = start + F.length(m["whole"]).cast("long")
            good = F.length(m["value"]) >= rule.least
            here = F.when(good, F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast(FOUND))
            return F.struct(end.alias("at"), (acc["k"] + 1).alias("k"), F.concat(acc["found"], here).alias("found"))

        whole = F.regexp_extract_all(text, p, F.lit(0))
        both = F.arrays_zip(whole.alias("whole"), (F.regexp_extract_all(text, p, F.lit(rule.group)) if rule.group else whole).alias("value"))
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("k"), F.array().cast(FOUND).alias("found"))
        return F.aggregate(both, zero, step)["found"]

    hint = rule.hint or rule.pattern
    there = F.contains(text, F.lit(hint)) if hint.replace(" ", "").replace("://", "").isalnum() else F.rlike(text, F.lit(hint))
    return F.when(there, let(F.split(text, pattern, -1), located)).otherwise(F.array().cast(FOUND))


def scan_versions(versions: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None,
                  id_columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger).

    findings: the id columns of every version with blob and ``found``, a map from rule to its spans. ledger: the old
    entries and those made now, to be written by the caller and given again next time.
    """
    ids = [c for c in versions.columns if c != text] if id_columns is None else list(id_columns)
    if clash := {"blob", "found"} & set(ids):
        raise ValueError(f"rename the id columns {sorted(clash)}: the result has columns of these names")
    spark, kept = versions.sparkSession, {f"_id{i}": c for i, c in enumerate(ids)}
    body = F.coalesce(F.col(text), F.lit(""))
    addressed = versions.select(F.sha2(body, 256).alias("blob"), body.alias("_text"), *[F.col(c).alias(k) for k, c in kept.items()])
    paths = written(addressed.select("blob", *kept), "paths")
    blobs = paths.select("blob").distinct()
    wanted = F.broadcast(spark.createDataFrame([(r.name, r.version) for r in rules], "rule string, version int"))
    every = F.array(*[F.lit(r.name) for r in rules])
    texts = addressed.select("blob", "_text")
    if ledger is None:
        texts = texts.withColumn("_rules", every)
    else:
        # what is known of the blobs at hand; a blob with rules to run gets its text, the others move none
        known = written(ledger.select("blob", "rule", "version", "found").join(wanted, ["rule", "version"]).join(blobs, "blob", "left_semi"), "known")
        seen = known.groupBy("blob").agg(F.collect_set("rule").alias("_seen"))
        todo = blobs.join(seen, "blob", "left").select("blob", F.array_except(every, F.coalesce("_seen", F.array().cast("array<string>"))).alias("_rules"))
        texts = texts.join(broadcast_if_small(todo.where(F.size("_rules") > 0), 256), "blob")
    # one text per blob, whichever row of it comes first: equal blobs have equal texts
    texts = texts.dropDuplicates(["blob"])
    each = F.array(*[F.when(F.array_contains("_rules", r.name), F.struct(
        F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), spans(F.col("_text"), r).alias("found"))) for r in rules])
    new = texts.select("blob", F.explode(F.array_compact(each)).alias("r")).select("blob", "r.rule", "r.version", "r.found")
    new = written(new, "ledger")
    now = (new if ledger is None else known.select(*new.columns).unionByName(new)).where(F.size("found") > 0)
    per_blob = now.groupBy("blob").agg(F.map_from_entries(F.collect_list(F.struct("rule", "found"))).alias("found"))
    empty = F.from_json(F.lit("{}"), "map<string, array<struct<start: bigint, end: bigint>>>")
    found = paths.join(per_blob, "blob", "left").select(*[F.col(k).alias(c) for k, c in kept.items()], "blob", F.coalesce("found", empty).alias("found"))
    return found, new if ledger is None else ledger.select(*new.columns).unionByName(new)


def listed(found: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of the rules' spans by start, then in the order of the rules, joined by commas."""
    none = F.array().cast("array<struct<start: bigint, at: int, said: string>>")

    def of(rule, at):
        held = F.coalesce(F.element_at(found, F.lit(rule.name)), F.array().cast(FOUND))
        return F.transform(held, lambda s: F.struct(s["start"].alias("start"), F.lit(at).alias("at"), F.concat(
            F.lit(rule.name + ":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")).alias("said")))

    every = reduce(F.concat, [of(r, i) for i, r in enumerate(rules)], none)
    return F.array_join(F.transform(F.sort_array(every), lambda s: s["said"]), ",")


def redact(text: Column, found: Column) -> Column:
    """The text with all spans replaced by [secret]; overlapping spans become one."""
    every = F.sort_array(F.flatten(F.map_values(found)))

    def step(acc, s):
        start = F.greatest(acc["at"], s["start"])
        fresh = s["start"] >= acc["at"]
        kept = F.when(fresh, F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (start - acc["at"]).cast("int")), F.lit("[secret]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), kept.alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(every, zero, step)
    return F.when(F.size(every) == 0, text).otherwise(let(done, lambda d: F.concat(d["out"], F.substring(text, (d["at"] + 1).cast("int"), F.length(text)))))
