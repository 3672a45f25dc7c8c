"""Technical metadata against expected values, policies, file names, validator logs, fixity and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written

FIELD = ["tool", "section", "field"]
#: Order of the tools in a report of differences.
TOOLS = ("exiftool", "mediainfo", "mediatrace", "ffprobe")


def check_spec(metadata: DataFrame, spec: DataFrame, trim: bool = False) -> DataFrame:
    """asset_id, tool, section, field, expected, actual: values that are not among the accepted ones. Absent fields and empty expectations pass."""
    value = F.trim("value") if trim else F.col("value")
    wide = metadata.join(spec.where(F.size(F.filter("accepted", lambda x: x != "")) > 0), FIELD)
    return wide.where(F.col("value").isNotNull() & ~F.array_contains("accepted", value)).select("asset_id", *FIELD, F.array_join("accepted", " | ").alias("expected"), F.col("value").alias("actual"))


#: Rows that a table of expectations may have to be held as one literal array; beyond it is joined as a table.
LITERAL_ROWS = 10_000
#: Renames of settings that are held so.
LITERAL_RENAMES = 100


def _for_each(assets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every asset (asset_id) with every row of `wanted`, a small table of expectations: held as one literal array where it has at most LITERAL_ROWS rows, else joined over salts."""
    types, rows = dict(wanted.dtypes), wanted.limit(LITERAL_ROWS + 1).collect()
    if len(rows) > LITERAL_ROWS:
        salt = assets.select("asset_id", F.pmod(F.xxhash64("asset_id"), F.lit(64)).cast("int").alias("_s"))
        return salt.join(wanted.withColumn("_s", F.explode(F.array(*map(F.lit, range(64))))), "_s").drop("_s")
    held = F.array(*[F.struct(*[F.lit(r[n]).cast(t).alias(n) for n, t in types.items()]) for r in rows])
    none = f"array<struct<{', '.join(f'`{n}`: {t}' for n, t in types.items())}>>"
    return assets.select("asset_id", F.explode(held if rows else held.cast(none)).alias("_x")).select("asset_id", "_x.*")


def validate_profile(metadata: DataFrame, assets: DataFrame, spec: DataFrame) -> DataFrame:
    """asset_id, section, matches, mismatches, missing, valid: every expected field of every asset.

    A value matches when it is, trimmed, one of the accepted ones. Where metadata has `values`, an array, and the field several accepted ones, all of
    these must be among the values. A field that is absent is missing unless nothing is expected of it.
    """
    several = F.col("values") if "values" in metadata.columns else F.lit(None).cast("array<string>")
    own = metadata.select("asset_id", *FIELD, "value", several.alias("_several"))
    wide = _for_each(assets, spec.select(*FIELD, "accepted")).join(own, ["asset_id", *FIELD], "left")
    one_of = F.array_contains(F.transform("accepted", lambda x: F.trim(x)), F.trim("value"))
    match = F.when(F.col("_several").isNotNull() & (F.size("accepted") > 1), F.size(F.array_except("accepted", "_several")) == 0).otherwise(one_of)
    absent = F.col("value").isNull() & F.col("_several").isNull()
    expected = F.exists("accepted", lambda x: x != "")
    one = wide.groupBy("asset_id", "section").agg(F.count_if(~absent & match).alias("matches"), F.count_if(~absent & ~match).alias("mismatches"), F.count_if(absent & expected).alias("missing"))
    return one.withColumn("valid", (F.col("mismatches") == 0) & (F.col("missing") == 0))


def check_presence(tags: DataFrame, assets: DataFrame, expected: list[str], names: dict[str, str] | None = None, mkv: str = "mkv") -> DataFrame:
    """asset_id, field, problem: fields of each asset that are not there or empty; of `names`, whose value does not hold the expected text, as differs.

    Commas of format_name count as blanks on both sides. ENCODER_SETTINGS is asked for only of assets whose extension is mkv, where
    assets has extension.
    """
    wanted = assets.select("asset_id", F.explode(F.array(*map(F.lit, [*expected, *(k for k in names or {} if k not in expected)]))).alias("field"))
    if "extension" in assets.columns:
        other = assets.where(F.lower(F.ltrim(F.col("extension"), F.lit("."))) != mkv).select("asset_id", F.lit("ENCODER_SETTINGS").alias("field"))
        wanted = wanted.join(other, ["asset_id", "field"], "left_anti")
    wide = wanted.join(tags.select("asset_id", "field", "value"), ["asset_id", "field"], "left")
    problem = F.when(F.col("value").isNull(), "not found").when(F.trim("value") == "", "empty")
    plain = lambda c: F.replace(c, F.lit(","), F.lit(" "))
    for k, text in (names or {}).items():
        have, want = (plain(F.col("value")), plain(F.lit(text))) if k == "format_name" else (F.col("value"), F.lit(text))
        problem = problem.when((F.col("field") == k) & ~F.contains(have, want), "differs")
    return wide.withColumn("problem", problem).where("problem is not null").select("asset_id", "field", "problem")


def check_encoder_settings(actual: DataFrame, expected: dict[str, list[str]]) -> DataFrame:
    """asset_id, device, problem, actual: devices of the expected signal flow that are absent or set otherwise (settings compare as sets)."""
    items = F.explode(F.array(*[F.struct(F.lit(d).alias("device"), F.array(*map(F.lit, sorted(set(v)))).alias("want")) for d, v in expected.items()]))
    own = actual.select("asset_id", "settings", items.alias("x")).select("asset_id", "x.*", F.try_element_at("settings", F.col("x.device")).alias("have"))
    problem = F.when(F.col("have").isNull(), "absent").when(F.array_sort(F.array_distinct("have")) != F.col("want"), "differs")
    return own.withColumn("problem", problem).where("problem is not null").select("asset_id", "device", "problem", F.array_join(F.coalesce("have", F.array()), ",").alias("actual"))


def _holds(op: Column, have: Column, want: Column) -> Column:
    a, b = have.try_cast("double"), want.try_cast("double")
    number = F.when(op == ">", a > b).when(op == ">=", a >= b).when(op == "<", a < b).when(op == "<=", a <= b)
    return F.coalesce(F.when(op == "=", have == want).when(op == "!=", have != want).when(op == "exists", have.isNotNull()).when(op == "must not exist", have.isNull()).otherwise(number), F.lit(False))


def check_policy(metadata: DataFrame, assets: DataFrame, rules: DataFrame) -> DataFrame:
    """asset_id, group_id, passed: rules (group_id, group_op, rule, tracktype, field, operator, value) of each group joined by its `and` or `or`."""
    wanted = _for_each(assets, rules)
    have = metadata.select("asset_id", F.col("section").alias("tracktype"), "field", F.col("value").alias("have"))
    wide = wanted.join(have, ["asset_id", "tracktype", "field"], "left").withColumn("ok", _holds(F.col("operator"), F.col("have"), F.col("value")))
    return wide.groupBy("asset_id", "group_id").agg(F.when(F.first("group_op") == "or", F.bool_or("ok")).otherwise(F.bool_and("ok")).alias("passed"))


def check_policy_tree(metadata: DataFrame, assets: DataFrame, nodes: DataFrame) -> DataFrame:
    """asset_id, policy, node_id, parent_id, passed: every rule and group of policies of any depth, for every asset.

    nodes: policy, node_id, parent_id (null: the whole policy), depth (0: the whole), op (and, or; null: a rule), tracktype, field, occurrence,
    operator, value. metadata: asset_id, section, field, value, and track_no (from 0) where there are several tracks of a section. A rule holds by
    its occurrence in any track (`*` or null), in all, or in the track of that number; a rule on a field that no track has is judged once. Groups are
    folded from the lowest level up, a round a level; a group without members passes. Rules and levels are written, as each is read by the level above
    and by the result, and no side of a join is held whole.
    """
    track = F.col("track_no").cast("string") if "track_no" in metadata.columns else F.lit("0")
    have = metadata.select("asset_id", F.col("section").alias("tracktype"), "field", F.col("value").alias("have"), track.alias("_track"))
    rules = _for_each(assets, nodes.where("op IS NULL").select("policy", "node_id", "parent_id", "depth", "tracktype", "field", F.coalesce("occurrence", F.lit("*")).alias("occurrence"), "operator", "value"))
    met = F.col("_track").isNull() | F.col("occurrence").isin("*", "all") | (F.col("occurrence") == F.col("_track"))
    wide = rules.join(have.hint("merge"), ["asset_id", "tracktype", "field"], "left").withColumn("ok", F.when(met, _holds(F.col("operator"), F.col("have"), F.col("value"))))
    ok = F.when(F.first("occurrence") == "all", F.bool_and("ok")).otherwise(F.bool_or("ok"))
    key = ["asset_id", "policy", "node_id", "parent_id", "depth"]
    judged = written(wide.groupBy(*key).agg(F.coalesce(ok, F.first("operator") == "must not exist").alias("passed")), "policy-rules")
    groups = nodes.where("op IS NOT NULL").select("policy", "node_id", "parent_id", "depth", "op")
    levels = [judged]
    deepest = groups.agg(F.max("depth")).first()[0]
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        # A group's own row and its members meet by an aggregation.
        below = [df.where(F.col("depth") == depth + 1).select("asset_id", "policy", F.col("parent_id").alias("node_id"), "passed") for df in ([judged, levels[-1]] if len(levels) > 1 else [judged])]
        level = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [_for_each(assets, groups.where(F.col("depth") == depth)), *below])
        level = level.groupBy("asset_id", "policy", "node_id").agg(F.max("parent_id").alias("parent_id"), F.max("depth").alias("depth"), F.max("op").alias("op"), F.bool_and("passed").alias("every"), F.bool_or("passed").alias("any"))
        passed = F.coalesce(F.when(F.col("op") == "or", F.col("any")).otherwise(F.col("every")), F.lit(True))
        levels.append(written(level.where("op IS NOT NULL").select(*key, passed.alias("passed")), "policy-level"))
    judged = reduce(DataFrame.unionByName, levels)
    return judged.select("asset_id", "policy", "node_id", "parent_id", "passed")


def policy_verdict(outcomes: DataFrame) -> DataFrame:
    """asset_id, fails, verdict from rows asset_id, passed."""
    one = outcomes.groupBy("asset_id").agg(F.count_if(~F.col("passed")).alias("fails"))
    return one.select("asset_id", "fails", F.when(F.col("fails") == 0, "pass").otherwise("fail").alias("verdict"))


def filename_reason(name: Column, sections: list[tuple[str, str]], extension: str) -> Column:
    """The first reason why a name breaks a profile of sections (kind, pattern), kind literal, wildcard or regex; null for a good name."""
    from ..functions.scalars import wildcard_to_regex

    stem, ext = F.regexp_extract(name, r"^(.*)\.([^.]*)$", 1), F.regexp_extract(name, r"^(.*)\.([^.]*)$", 2)
    parts = F.split(stem, "_")
    reason = F.when(F.lower(ext) != extension.lower(), "extension").when(F.size(parts) != len(sections), "sections")
    for k, (kind, pattern) in enumerate(sections):
        part = parts.getItem(k)
        good = part == pattern if kind == "literal" else part.rlike(f"(?i)^(?:{wildcard_to_regex(pattern) if kind == 'wildcard' else pattern})$")
        reason = reason.when(~good, f"section {k + 1}")
    return reason


# Why a step stands as it does.
STEP_REASONS = {"disabled": "Disabled in configuration", "precondition_not_met": "Precondition not met", "already_exists": "Output already exists", "will_run": "Ready to run"}


def step_readiness(inventory: DataFrame, steps: DataFrame) -> DataFrame:
    """asset_id, step, status, reason, missing, warnings: for each step of each asset, whether it will run and why not.

    inventory: asset_id, items (an array of what there is). steps: step_no, step, enabled, needs, wants (arrays of items) and makes (an item or
    null), a small table. In their order, a step that is enabled, has all it needs and whose output is not there yet will run, and what it makes is
    there for those after it; what a step that will not run would have made is not. `missing`: what it needs and lacks, where it is enabled. `warnings`:
    what a step that will run wants and lacks, and so leaves out silently. Disabled goes before precondition_not_met before already_exists.
    """
    rows = steps.select("step_no", "step", "enabled", "needs", "wants", "makes").limit(LITERAL_ROWS + 1).collect()
    if len(rows) > LITERAL_ROWS:
        raise ValueError(f"over {LITERAL_ROWS} steps")
    texts = lambda x: F.array(*map(F.lit, x or [])).cast("array<string>")
    item = lambda r: F.struct(F.lit(r.step).alias("step"), F.lit(bool(r.enabled)).alias("enabled"), texts(r.needs).alias("needs"), texts(r.wants).alias("wants"), F.lit(r.makes).cast("string").alias("makes"))
    plan = F.array(*map(item, sorted(rows, key=lambda r: r.step_no)))
    done = "array<struct<step: string, status: string, missing: array<string>, wanted: array<string>>>"
    begin = F.struct(F.coalesce("items", texts([])).alias("items"), F.array().cast(done).alias("done"))

    def judge(state: Column, s: Column) -> Column:
        lacks = F.array_except(s["needs"], state["items"])
        there = F.coalesce(F.array_contains(state["items"], s["makes"]), F.lit(False))
        status = F.when(~s["enabled"], "disabled").when(F.size(lacks) > 0, "precondition_not_met").when(there, "already_exists").otherwise("will_run")
        none = texts([])
        out = F.struct(s["step"].alias("step"), status.alias("status"), F.when(s["enabled"], lacks).otherwise(none).alias("missing"), F.when(status == "will_run", F.array_except(s["wants"], state["items"])).otherwise(none).alias("wanted"))
        items = F.when((status == "will_run") & s["makes"].isNotNull(), F.array_append(state["items"], s["makes"])).otherwise(state["items"])
        return F.struct(items.alias("items"), F.array_append(state["done"], out).alias("done"))

    found = inventory.select("asset_id", F.explode(F.aggregate(plan, begin, judge, lambda state: state["done"])).alias("x")).select("asset_id", "x.*")
    reason = F.lit(None).cast("string")
    for status, text in STEP_REASONS.items():
        reason = F.when(F.col("status") == status, text).otherwise(reason)
    missing = F.array_join("missing", ", ")
    return found.select("asset_id", "step", "status", F.when(missing != "", F.concat(reason, F.lit(": "), missing)).otherwise(reason).alias("reason"), missing.alias("missing"), F.array_join("wanted", ", ").alias("warnings"))


def only_specified(metadata: DataFrame, spec: DataFrame) -> DataFrame:
    """metadata of the fields that a specification (tool, section, field) names."""
    return metadata.join(spec.select(*FIELD).distinct(), FIELD, "left_semi")


def migrate_settings(settings: DataFrame, renames: DataFrame) -> DataFrame:
    """asset_id, path, value: settings (asset_id, path with dots, value) under their new names.

    renames: old, new (paths), a small table. The longest old path that a setting's path is, or begins with before a dot, gives way to its new one; where
    a setting stands under the new name already, that one wins. yes and no of renamed settings become true and false; others stay as they are.
    """
    roots = F.transform(F.sequence(F.lit(1), F.size(F.split("path", r"\."))), lambda k: F.array_join(F.slice(F.split("path", r"\."), F.lit(1), k), "."))
    rows = renames.select("old", "new").where("old IS NOT NULL AND new IS NOT NULL").limit(LITERAL_RENAMES + 1).collect()
    if len(rows) > LITERAL_RENAMES:
        tried = settings.select("asset_id", "path", "value", F.explode_outer(roots).alias("old"))
        found = tried.join(renames.select("old", "new"), "old", "left").groupBy("asset_id", "path", "value").agg(F.max(F.when(F.col("new").isNotNull(), F.struct(F.length("old").alias("n"), "old", "new"))).alias("x"))
    else:
        # Held with each setting, which is neither copied nor gathered to find its own.
        names = F.array(*[F.struct(F.lit(len(r.old)).alias("n"), F.lit(r.old).alias("old"), F.lit(r.new).alias("new")) for r in rows]).cast("array<struct<n: int, old: string, new: string>>")
        found = settings.select("asset_id", "path", "value", F.array_max(F.filter(names, lambda x: (F.col("path") == x["old"]) | F.startswith(F.col("path"), F.concat(x["old"], F.lit("."))))).alias("x"))
    moved = F.col("x").isNotNull()
    path = F.when(moved, F.concat("x.new", F.substr("path", F.length("x.old") + 1))).otherwise(F.col("path"))
    truth = F.when(moved & (F.lower("value") == "yes"), "true").when(moved & (F.lower("value") == "no"), "false").otherwise(F.col("value"))
    own = found.select("asset_id", path.alias("path"), F.struct(moved.alias("moved"), F.col("path").alias("was"), truth.alias("value")).alias("x"))
    # Short settings pack so well that partitions sized by their written bytes would be a few large sorts.
    spark = settings.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return own.repartition(tasks, "asset_id").groupBy("asset_id", "path").agg(F.min("x").alias("x")).select("asset_id", "path", "x.value")


def metadata_difference_report(parts: dict[str, DataFrame]) -> DataFrame:
    """asset_id, tool_rank, tool, field, expected, actual: all tools' differences in the tools' order."""
    frames = [df.select("asset_id", F.lit(TOOLS.index(t)).alias("tool_rank"), F.lit(t).alias("tool"), "field", "expected", "actual") for t, df in parts.items()]
    return reduce(DataFrame.unionByName, frames)


def classify_validator_line(line: Column) -> Column:
    """struct(kind, code, offset): cluster offsets (WRN0C2), other warnings, errors, the verdict, progress, other."""
    code = F.regexp_extract(line, r"^(WRN[0-9A-F]{3}|ERR[0-9A-F]{3})", 1)
    kind = F.when(code == "WRN0C2", "cluster").when(code.startswith("WRN"), "warning").when(code.startswith("ERR"), "error").when(line.rlike(r"(?i)is valid|is not valid|invalid|appears to be"), "verdict").when(line.rlike(r"^\.*$"), "progress").otherwise("other")
    return F.struct(kind.alias("kind"), F.when(code != "", code).alias("code"), F.regexp_extract(line, r"(?i)cluster at (\d+)", 1).try_cast("long").alias("offset"))


def validator_summary(lines: DataFrame) -> DataFrame:
    """asset_id, errors, clusters, warnings, verdict, invalid: from rows asset_id, line_no, line."""
    own = lines.withColumn("x", classify_validator_line(F.col("line")))
    n = lambda k: F.count_if(F.col("x.kind") == k).cast("long")
    one = own.groupBy("asset_id").agg(n("error").alias("errors"), n("cluster").alias("clusters"), n("warning").alias("warnings"), F.max_by("line", F.when(F.col("x.kind") == "verdict", F.col("line_no"))).alias("verdict"))
    return one.withColumn("invalid", (F.col("errors") > 0) | F.coalesce(F.col("verdict").rlike("(?i)not valid|invalid"), F.lit(False)))


def fixity_verdict(stored: DataFrame, computed: DataFrame, configured: str = "md5") -> DataFrame:
    """asset_id, algorithm, checksum, verdict: stored checksums (asset_id, file_date, algorithm, checksum) of the configured algorithm, or of the newest one where it is not stored, all match."""
    pick = stored.groupBy("asset_id").agg(F.bool_or(F.col("algorithm") == configured).alias("has"), F.max_by("algorithm", F.struct("file_date", "algorithm")).alias("newest"))
    own = stored.join(pick.select("asset_id", F.when(F.col("has"), configured).otherwise(F.col("newest")).alias("algorithm")), ["asset_id", "algorithm"])
    wide = own.join(computed.select("asset_id", "algorithm", F.col("checksum").alias("now")), ["asset_id", "algorithm"], "left")
    same = F.coalesce(F.lower("checksum") == F.lower("now"), F.lit(False))
    return wide.groupBy("asset_id", "algorithm").agg(F.max_by("checksum", F.struct("file_date", "checksum")).alias("checksum"), F.when(F.count("now") == 0, "not computed").when(F.bool_and(same), "match").otherwise("differ").alias("verdict"))


def verify_stream_hash(stored: DataFrame, computed: DataFrame, configured: str = "md5") -> DataFrame:
    """asset_id, stream, verdict: missing, algorithm mismatch, match or differ, for video and audio apart."""
    wide = computed.select("asset_id", "stream", F.col("hash").alias("now")).join(stored.select("asset_id", "stream", "algorithm", "hash"), ["asset_id", "stream"], "left")
    verdict = F.when(F.col("hash").isNull(), "missing").when(F.col("algorithm") != configured, "algorithm mismatch").when(F.lower("hash") == F.lower("now"), "match").otherwise("differ")
    return wide.select("asset_id", "stream", verdict.alias("verdict"))


def merge_profiles(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """name, body: both sets; incoming names that are taken become `name (imported)`, `name (imported 2)` and so on."""
    taken = existing.select("name").distinct().withColumn("taken", F.lit(True))
    own = incoming.join(taken, "name", "left").withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("body")))
    place = F.when(F.col("taken").isNull(), F.col("k") - 1).otherwise(F.col("k"))
    name = F.when(place == 0, F.col("name")).when(place == 1, F.concat("name", F.lit(" (imported)"))).otherwise(F.concat("name", F.lit(" (imported "), place.cast("string"), F.lit(")")))
    return existing.select("name", "body").unionByName(own.select(name.alias("name"), "body"))


def merge_signal_flow(spec: DataFrame, profile: DataFrame) -> DataFrame:
    """device, settings: the profile's devices replace the spec's, others stay."""
    wide = spec.select("device", F.col("settings").alias("a")).join(profile.select("device", F.col("settings").alias("b")), "device", "full_outer")
    return wide.select("device", F.coalesce("b", "a").alias("settings"))


def apply_defaults(metadata: DataFrame, assets: DataFrame, fields: list[str]) -> DataFrame:
    """asset_id, field, value: every field of every asset, empty where it is missing."""
    wanted = assets.select("asset_id", F.explode(F.array(*map(F.lit, fields))).alias("field"))
    return wanted.join(metadata.select("asset_id", "field", "value"), ["asset_id", "field"], "left").select("asset_id", "field", F.coalesce("value", F.lit("")).alias("value"))
