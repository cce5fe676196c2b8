"""The rule language: what a rule may say, which files it takes, where its output goes."""

from __future__ import annotations

import json
import string
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import media as M
from ..functions import metrics as X

#: Order in which operations are carried out.
PHASES = ["copy", "compress", "move", "delete"]
#: What may be said, and other spellings of it.
CHOICES: dict[str, tuple[set, dict]] = {
    "folder_scope mode": ({"all", "only", "except"}, {"all_except": "except"}),
    "origin": ({"source", "managed", "either"}, {"external": "source", "all": "either", None: "either"}),
    "operation": (set(PHASES), {}),
}
#: Names that a portable path must not use.
DEVICES = "con|prn|aux|nul|com[1-9]|lpt[1-9]"


#: What a rule says about every file that it takes.
TOLD = "array<struct<rule_id:string,position:int,operation:string,replace:boolean,in_place:boolean,policy:string,profile_id:string,codec:string,depends_on:string,__ratio:double>>"


def chosen(what: str, value):
    allowed, spellings = CHOICES[what]
    value = spellings.get(value, value)
    if value not in allowed:
        raise ValueError(f"{what} is {value!r}, not one of {', '.join(sorted(allowed))}")
    return value


def folder_list(values) -> list[str]:
    """Folders as they are compared: forward slashes, none outside, without case, each once."""
    plain = {str(v).replace("\\", "/").strip("/").casefold() for v in values} - {""}
    for path in plain:
        if not {"", ".", ".."}.isdisjoint(path.split("/")) or "\0" in path:
            raise ValueError(f"not a folder below the root: {path!r}")
    return sorted(plain)


def narrowed(single, several, fold: Callable = str) -> list[str] | None:
    """One value, a list of them, or both: what satisfies all that is given; None is no condition."""
    given = [{fold(v) for v in s} for s in ([single] if single else None, several) if s]
    return sorted(set.intersection(*given)) if given else None


@dataclass(frozen=True)
class Rule:
    """A checked rule.  None is no condition."""

    rule_id: str
    position: int
    media_type: str | None
    extensions: list[str] | None
    scope: str | None
    folders: list[str]
    formats: list[str] | None
    representation: str | None
    origin: str | None
    role: str | None
    states: list[str] | None
    state_not: str | None
    min_bytes: int | None
    max_bytes: int | None
    operation: str
    replace: bool
    policy: str
    action: dict = field(compare=False)

    def condition(self) -> Column:
        """Whether a file with the columns of :func:`described_files` is taken, as far as its origin does not decide."""
        path, size = F.col("__path"), F.coalesce("size_bytes", F.lit(0))
        inside = reduce(lambda a, b: a | b, [(path == f) | path.startswith(f + "/") for f in self.folders], F.lit(False))
        tests = {
            "media_type": lambda v: F.col("media_type") == v,
            "extensions": lambda v: F.col("__ext").isin(v),
            "scope": lambda v: inside if v == "only" else ~inside,
            "formats": lambda v: F.col("__format").isin(v),
            "representation": lambda v: F.col("__class") == v,
            "role": lambda v: F.col("role") == v,
            "states": lambda v: F.col("selection_state").isin(v),
            "state_not": lambda v: ~F.col("selection_state").eqNullSafe(v),
            "min_bytes": lambda v: size >= v,
            "max_bytes": lambda v: size <= v,
        }
        given = [test(getattr(self, name)) for name, test in tests.items() if getattr(self, name) is not None]
        return reduce(lambda a, b: a & b, given, F.lit(True))


def checked(rule: dict) -> Rule:
    """A rule as written (rule_id, position, match, action), checked and in one spelling."""
    m, action = rule.get("match") or {}, dict(rule.get("action") or {})
    scope = m.get("folder_scope") or ({"mode": "only", "paths": [m["folder_prefix"]]} if m.get("folder_prefix") else {})
    if not isinstance(scope, dict):
        raise ValueError("folder_scope is written as {mode, paths}")
    mode, origin = chosen("folder_scope mode", scope.get("mode", "all")), chosen("origin", m.get("origin"))
    number = lambda key: None if m.get(key) is None else int(m[key])
    policy = action.get("conflict_policy")
    if policy not in ("rename", "skip", "overwrite"):  # an older switch
        policy = "skip" if action.get("rename_on_conflict") is False else "rename"
    return Rule(
        rule_id=rule["rule_id"], position=rule["position"], media_type=m.get("media_type") or None, extensions=narrowed(None, m.get("extensions"), lambda v: str(v).casefold()),
        scope=None if mode == "all" else mode, folders=folder_list(scope.get("paths") or []), formats=narrowed(m.get("format"), m.get("formats"), lambda v: str(v).casefold()),
        representation=m.get("representation_class") or None, origin=None if origin == "either" else origin, role=m.get("role") or None,
        states=narrowed(m.get("selection_state"), m.get("selection_states")), state_not=m.get("selection_state_not") or None, min_bytes=number("min_size_bytes"), max_bytes=number("max_size_bytes"),
        operation=chosen("operation", action.get("operation", "compress")), replace=action.get("source_disposition") == "replace", policy=policy, action=action,
    )


def enabled_rules(rules: list[dict]) -> list[Rule]:
    return sorted((checked(r) for r in rules if r.get("enabled", True)), key=lambda r: r.position)


def _joined(*parts: Column) -> Column:
    """Path parts with slashes between those that are not empty."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "/")


def described_files(files: DataFrame) -> DataFrame:
    """files with what conditions read."""
    path, ext = F.col("relative_path"), F.col("extension")
    return files.withColumns({"__path": M.casefold(path), "__ext": F.lower(ext), "__format": M.format_name(ext), "__class": M.representation_class(ext)})


def prepared_files(files: DataFrame) -> DataFrame:
    """files with what targets read."""
    path = F.col("relative_path")
    return files.withColumns({"__name": M.base_name(path), "__stem": M.stem(path), "__folder": M.parent_folder(path)})


def _once(rows: DataFrame, *columns: Column) -> DataFrame:
    """rows with columns that a filter behind them does not spell out again."""
    return rows.select("*", F.inline(F.array(F.struct(*columns))))


def target_of(rule: Rule, profile: dict | None) -> Column:
    """Where a rule puts a file of :func:`prepared_files`, before it is checked; null if the rule does not say."""
    none, action = F.lit(None).cast("string"), rule.action
    if rule.operation == "delete":
        return none
    name, stem, folder, container = F.col("__name"), F.col("__stem"), F.col("__folder"), F.lit((profile or {}).get("container", ""))
    if action.get("destination_dir") is not None:
        directory = str(action["destination_dir"]).replace("\\", "/")
        directory = directory if not directory.endswith("/") else directory.rstrip("/") or "/"
        keeps = action.get("compress_in_place", True) if rule.operation == "compress" else action.get("preserve_relative_structure", False)
        output = F.concat(stem, F.lit("."), container) if rule.operation == "compress" else name
        return _joined(F.lit(directory), folder if keeps else F.lit(""), output)
    template = action.get("target_template")
    if not template:
        return none if profile is None else _joined(folder, F.concat(stem, F.lit("."), container))
    values = {"filename": name, "stem": stem, "ext": F.regexp_replace(F.substring(name, F.length(stem) + 1, F.length(name)), r"^\.", ""), "relative_dir": folder, "container": container}
    try:
        pieces = list(string.Formatter().parse(str(template)))
    except ValueError:
        return none
    if any(name not in (None, *values) for _, name, _, _ in pieces):
        return none
    return F.translate(F.concat(*[part for text, name, _, _ in pieces for part in [F.lit(text), *([values[name]] if name else [])]]), "\\", "/")


def path_problem(path: Column, state_folder: str = ".lumaloom") -> Column:
    """Why a target path is not safe; null if it is."""
    # one look at the path tells whether it could be any of these; most are none
    odd = path.rlike(rf'[<>:"|?*\\\x00-\x1f]|[ .](/|$)|(^|/)(\.|/|$|(?i:{DEVICES}))') | path.startswith(" ") | F.lower(path).contains(state_folder)
    return F.when(path.isNull() | ~odd, None).otherwise(
        F.when((path == "") | (F.trim(path) != path) | path.contains("\0"), "malformed")
        .when(path.rlike(r"^[/\\]|^[A-Za-z]:[/\\]"), "absolute")
        .when(path.rlike(r"(^|/)\.\.(/|$)"), "parent")
        .when(path.rlike(r'[<>:"|?*\x00-\x1f]'), "character")
        .when(path.rlike(r"(^|/)\.?(/|$)"), "malformed")
        .when(path.rlike(r"[ .](/|$)"), "trailing")
        .when(F.lower(path).rlike(rf"(^|/)({DEVICES})(\.[^/]*)?(/|$)"), "device")
        .when(F.array_contains(F.split(F.lower(path), "/"), state_folder), "state folder")
    )


def managed_outputs(files: DataFrame, copies: DataFrame, derivatives: DataFrame, asked: Column | None = None) -> DataFrame:
    """files with ``managed_output``: provenance (file_id, output_path, output_sha256) still describes the file.

    asked: files for which it is looked up, all without it; for others it is false.
    Rows meet by the file alone, so that what follows finds them dealt out by it.
    """
    names = ["file_id", "output_path", "output_sha256"]
    claims = copies.select(*names).union(derivatives.select(*names)).dropna().repartition("file_id").distinct()
    # a row for each claim that a file could meet; the flag is one column whatever their number
    proven = claims.select(F.col("file_id").alias("__f"), F.struct(F.col("output_path").alias("path"), F.col("output_sha256").alias("sha256")).alias("__claim"), F.lit(True).alias("managed_output"))
    known = F.col("relative_path").isNotNull() & F.col("sha256").isNotNull()
    own = F.when(known if asked is None else known & asked, F.struct(F.col("relative_path").alias("path"), "sha256"))
    same = (F.col("file_id") == F.col("__f")) & F.array_contains(F.array("__claim"), F.col("__own"))
    return files.withColumn("__own", own).join(proven, same, "left").drop("__f", "__claim", "__own").withColumn("managed_output", F.coalesce("managed_output", F.lit(False)))


def output_ratio(profile: dict | None) -> float:
    """What part of a file's size its compression is expected to leave."""
    settings = (profile or {}).get("settings") or {}
    if "estimated_output_ratio" in settings:
        return max(0.01, min(1.0, float(settings["estimated_output_ratio"])))
    if (profile or {}).get("codec") != "jpeg-xl":
        return 0.5
    quality = float(settings["quality"]) if "quality" in settings else min(100.0, max(0.0, 100 - float(settings.get("distance", 1.5)) * 40 / 1.5))
    return {80: 0.5, 60: 0.35, 40: 0.25}.get(round(quality), 0.35)


def _told(rules: list[dict], profiles: list[dict], number: Column) -> Column:
    """What the enabled rule of a number, from 0, says about every file that it takes."""
    by_id, told = {p["profile_id"]: p for p in profiles}, []
    for rule in enabled_rules(rules):
        profile = by_id.get(rule.action.get("profile_id"))
        told.append({
            "rule_id": rule.rule_id, "position": rule.position, "operation": rule.operation, "replace": rule.replace, "in_place": rule.replace and rule.operation == "compress" and bool(rule.action.get("compress_in_place", True)),
            "policy": rule.policy, "profile_id": rule.action.get("profile_id"), "codec": (profile or {}).get("codec"), "depends_on": rule.action.get("depends_on_rule_id"), "__ratio": output_ratio(profile),
        })
    return F.element_at(F.from_json(F.lit(json.dumps(told)), TOLD), number + 1)


def _estimated(operations: DataFrame) -> DataFrame:
    size = F.coalesce("size_bytes", F.lit(0))
    output = operations.withColumn("estimated_bytes", F.when(size == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(size * F.col("__ratio")))).cast("long"))
    return output.withColumn("storage_delta", X.storage_delta(size, F.col("estimated_bytes"), F.col("operation"), F.col("replace")))


#: Columns of an operation that follow from its rule and the size of its file.
FROM_RULE = ["rule_id", "position", "operation", "replace", "in_place", "policy", "profile_id", "codec", "depends_on", "estimated_bytes", "storage_delta"]


def slim(operations: DataFrame, rules: list[dict]) -> DataFrame:
    """operations of :func:`match_rules` with the number of their rule, as ``rule_number``, for what :func:`spelled` adds again after an exchange."""
    ids = F.array(*[F.lit(r.rule_id) for r in enabled_rules(rules)])
    return operations.withColumn("rule_number", (F.array_position(ids, F.col("rule_id")) - 1).cast("int")).drop(*FROM_RULE)


def spelled(operations: DataFrame, rules: list[dict], profiles: list[dict]) -> DataFrame:
    told = operations.withColumn("h", _told(rules, profiles, F.col("rule_number"))).select(*operations.columns, "h.*")
    return _estimated(told).drop("__ratio")


def match_rules(files: DataFrame, rules: list[dict], profiles: list[dict] = (), provenance: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """A row for every file and rule that takes it, in the order of rules, with what the rule would do and ``conflicts``.

    Rules are known when the query is planned, so they become one array of
    compiled conditions that is exploded: one scan, no join, and all that rules
    of one file have against each other is seen before any row leaves its task.
    files needs ``selection_state``, and ``managed_output`` or else the provenance
    (copies, derivatives) that :func:`managed_outputs` finds it by.  Then only files
    that a rule may take meet provenance, and are looked up if it decides.
    """
    by_id, checked_rules = {p["profile_id"]: p for p in profiles}, enabled_rules(rules)
    raw = F.lit(None).cast("string")
    for i, rule in enumerate(checked_rules):
        raw = F.when(F.col("__rule") == i, target_of(rule, by_id.get(rule.action.get("profile_id")))).otherwise(raw)
    of = lambda test: F.expr(f"cast(array({', '.join(str(i) for i, r in enumerate(checked_rules) if test(r))}) as array<int>)")
    moves, deletes, copies = (of(lambda r, n=name: r.operation == n) for name in ("move", "delete", "copy"))
    terminal, replaces = of(lambda r: r.operation in ("delete", "move")), of(lambda r: r.operation == "compress" and r.replace)
    n = lambda ids: F.size(F.array_intersect("__hits", ids))
    several = (n(terminal) > 1) | ((n(terminal) > 0) & (n(replaces) > 0))

    hits = F.array_compact(F.array(*[F.when(r.condition(), F.lit(i)) for i, r in enumerate(checked_rules)])).cast("array<int>")
    some = _once(described_files(files), hits.alias("__some")).filter(F.size("__some") > 0).select(*files.columns, "__some")
    if provenance is not None:
        decides = F.arrays_overlap("__some", of(lambda r: r.origin is not None))
        some = managed_outputs(some, *provenance, decides & (M.representation_origin(F.col("role"), F.lit(False)) == "source"))
    managed = M.representation_origin(F.col("role"), F.col("managed_output")) == "managed"
    others = F.when(managed, of(lambda r: r.origin == "source")).otherwise(of(lambda r: r.origin == "managed"))
    taken = prepared_files(_once(some, F.array_except("__some", others).alias("__hits")).filter(F.size("__hits") > 0))
    ready = taken.withColumns({"__moves": n(moves) > 1, "__several": several, "__both": (n(deletes) > 0) & (n(copies) > 0)})
    one = ready.select("*", F.explode("__hits").alias("__rule")).withColumn("h", _told(rules, profiles, F.col("__rule"))).select("*", "h.*").withColumn("__raw", raw)
    operation = F.col("operation")
    one = one.withColumn("problem", F.when(operation != "delete", F.coalesce(path_problem(F.col("__raw")), F.when(F.col("__raw").isNull(), "no target"))))
    one = _estimated(one)
    ends = operation.isin("delete", "move") | ((operation == "compress") & F.col("replace"))
    return one.select(
        *files.columns, "rule_id", "position", "operation", "replace", "in_place", "policy", "profile_id", "codec", "depends_on", F.when(F.col("problem").isNull(), F.col("__raw")).alias("target"),
        "estimated_bytes", "storage_delta",
        F.array_compact(F.array(
            F.col("problem"),
            F.when((operation == "move") & F.col("__moves"), "several moves"),
            F.when(ends & F.col("__several"), "terminal operations"),
            F.when(operation.isin("delete", "copy") & F.col("__both"), "copied and deleted"),
        )).alias("conflicts"),
    )
