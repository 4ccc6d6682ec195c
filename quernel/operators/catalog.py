"""The catalogs of skills and models: shadowing, lookup, routing, model names."""

from __future__ import annotations

import hashlib
import importlib
import importlib.abc
import importlib.util
import sys
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quernel.errors import BadSkill, NoSkill
from quernel.functions.text import casefold, overlap, strip, tokens
from quernel.operators.scoring import call_with_retry
from quernel.sources.scratch import files_in, read_text

#: Skills up to which a word pairs them with requests one by one.
COMMON = 64
#: Skills that a selector is offered.
SHORTLIST = 20


def latest_wins(rows: DataFrame, key: str, priority: str) -> DataFrame:
    """Of each key the row with the highest priority."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), priority).alias("r")).select(key, *[f"r.{c}" for c in others])


def shadowed(skills: DataFrame) -> DataFrame:
    """One row a name: a user's skill shadows a built-in one, a later folder an earlier one."""
    ranked = skills.withColumn("priority", F.struct((F.col("source") == "user").cast("int").alias("user"), F.col("directory").alias("directory")))
    return latest_wins(ranked, "name", "priority").drop("priority")


def names(skills: DataFrame) -> DataFrame:
    return skills.select("name").orderBy("name")


def by_source(skills: DataFrame, source: str = "all") -> DataFrame:
    """Skills of one source, or ``all`` of them, in order of name."""
    kept = skills if source == "all" else skills.where(F.col("source") == source)
    return kept.orderBy("name")


def get_skill(skills: DataFrame, name: str) -> dict:
    found = skills.where(F.col("name") == name).first()
    if found is None:
        raise NoSkill(name, [r["name"] for r in names(skills).collect()])
    return found.asDict()


def _listed(skills: DataFrame) -> DataFrame:
    return skills.select("name", tokens(F.concat_ws(" ", "name", "description")).alias("words"))


def _best(marks: DataFrame, key: str, top: int) -> DataFrame:
    """(key, ranked): of rows (key, name, overlap) the first ``top`` a key, best first, ties by name."""
    order = F.array_sort(F.collect_set(F.struct((-F.col("overlap")).alias("minus"), "name")))
    named = F.transform(F.slice(order, 1, top), lambda m: F.struct(m["name"].alias("name"), (-m["minus"]).cast("int").alias("overlap")))
    return marks.groupBy(key).agg(named.alias("ranked"))


def rank_skills(requests: DataFrame, skills: DataFrame, request: str = "request", top: int = 2, common: int = COMMON) -> DataFrame:
    """Add ``ranked``: (name, overlap) of the ``top`` skills that share the most words, best first, ties by name.

    An inverted index, with one answer at every size of the catalog, whose sides Spark broadcasts or
    shuffles by their size.  Distinct requests meet skills only through words that at most ``common``
    skills have.  Words of more skills would pair nearly all requests with nearly all skills, so there
    the distinct sets of such words meet, each standing for all requests or skills that have it: a skill
    that shares no rarer word can only rank among the first of its set.  Fewer sharing skills than
    ``top`` are followed by others in order of name, with an overlap of 0.
    """
    key = F.md5(F.coalesce(F.col(request), F.lit("")))
    asked = requests.select(key.alias("__key"), F.col(request).alias("__request")).groupBy("__key").agg(F.first("__request").alias("__request"))
    asked = asked.select("__key", F.explode(tokens(F.col("__request"))).alias("word"))
    listed = _listed(skills).select("name", F.explode("words").alias("word"))
    spread = listed.groupBy("word").agg((F.count("*") > common).alias("frequent"))
    asked, listed = asked.join(spread, "word"), listed.join(spread, "word")

    def frequent_sets(rows: DataFrame, owner: str, words: str, name: str) -> DataFrame:
        """(owner, words, name): the owner's frequent words, and what tells the set apart."""
        sets = rows.where("frequent").groupBy(owner).agg(F.array_sort(F.collect_set("word")).alias(words))
        return sets.withColumn(name, F.md5(F.array_join(words, " ")))

    own, theirs = frequent_sets(asked, "__key", "own", "own_set"), frequent_sets(listed, "name", "theirs", "their_set")
    rare = asked.where("NOT frequent").join(listed.where("NOT frequent"), "word").groupBy("__key", "name").agg(F.count("*").alias("n"))
    both = rare.join(own, "__key", "left").join(theirs, "name", "left")
    shared = F.coalesce(overlap(F.col("own"), F.col("theirs")), F.lit(0))
    marks = both.select("__key", "name", (F.col("n") + shared).alias("overlap"))

    first = theirs.groupBy("their_set").agg(F.slice(F.array_sort(F.collect_set("name")), 1, top).alias("names"))
    a = own.select("own_set", F.explode("own").alias("word")).distinct()
    b = theirs.select("their_set", F.explode("theirs").alias("word")).distinct()
    of_sets = a.join(b, "word").groupBy("own_set", "their_set").agg(F.count("*").alias("overlap")).join(first, "their_set")
    of_sets = _best(of_sets.select("own_set", F.explode("names").alias("name"), "overlap"), "own_set", top)
    marks = marks.unionByName(own.join(of_sets, "own_set").select("__key", F.inline("ranked")))
    ranked = _best(marks.groupBy("__key", "name").agg(F.max("overlap").alias("overlap")), "__key", top)

    none = F.array().cast("array<struct<name:string,overlap:int>>")
    # At most `top` names are taken by what shares a word, so twice as many are enough to fill up.
    spare = [r["name"] for r in names(skills).limit(2 * top).collect()]
    fill = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(0).alias("overlap")) for n in spare]) if spare else none
    found = F.coalesce("ranked", none)
    others = F.filter(fill, lambda s: ~F.exists(found, lambda r: r["name"] == s["name"]))
    return requests.withColumn("__key", key).join(ranked, "__key", "left").withColumn("ranked", F.slice(F.concat(found, others), 1, top)).drop("__key")


def route(requests: DataFrame, skills: DataFrame, request: str = "request", selector: Callable[[str, list[tuple[str, str]]], str] | None = None, retries: int = 2, shortlist: int = SHORTLIST) -> DataFrame:
    """Add ``skill`` and ``reason``: an exact name, or the one skill that shares the most
    words; null and ``ambiguous`` where no single one does.

    ``selector`` may settle ambiguous requests: a function of the request and a list of (name,
    description), which returns a name; one that isn't on the list leaves it ambiguous.  The list
    holds the best ``shortlist`` skills in order of name, and so the whole of a smaller catalog.
    It runs in batches, like any model call, and transient failures are tried again.
    """
    top = 2 if selector is None else max(2, shortlist)
    by_name = skills.groupBy(casefold(F.col("name")).alias("__asked")).agg(F.min("name").alias("__exact"))
    ranked = rank_skills(requests, skills, request, top).withColumn("__asked", casefold(strip(F.col(request)))).join(by_name, "__asked", "left").drop("__asked")
    best, second = F.get("ranked", F.lit(0)), F.coalesce(F.get("ranked", F.lit(1))["overlap"], F.lit(0))
    single = F.coalesce((best["overlap"] > 0) & (best["overlap"] > second), F.lit(False))
    skill = F.when(F.col("__exact").isNotNull(), F.col("__exact")).when(single, best["name"])
    reason = F.when(F.col("__exact").isNotNull(), "exact name match").when(single, F.concat(F.lit("keyword match (score "), best["overlap"].cast("string"), F.lit(")"))).otherwise("ambiguous")
    out = ranked.withColumns({"skill": skill, "reason": reason})
    if selector is None:
        return out.drop("ranked", "__exact")
    return _settled(out.drop("__exact"), skills, request, selector, retries, requests.columns)


def _settled(routed: DataFrame, skills: DataFrame, request: str, selector: Callable[[str, list[tuple[str, str]]], str], retries: int, columns: list[str]) -> DataFrame:
    """Ambiguous requests by ``selector``, each distinct one asked once with its shortlist."""
    key = F.md5(F.coalesce(F.col(request), F.lit("")))
    routed = routed.withColumn("__key", key)
    open_ = routed.where(F.col("skill").isNull()).groupBy("__key").agg(F.first(request).alias("__request"), F.first("ranked").alias("ranked"))
    offered = open_.select("__key", "__request", F.explode_outer(F.transform("ranked", lambda r: r["name"])).alias("name")).join(skills.select("name", "description"), "name", "left")
    lists = offered.groupBy("__key").agg(F.first("__request").alias("__request"), F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", F.coalesce("description", F.lit("")).alias("description"))))).alias("offered"))

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            chosen: list[str | None] = []
            for text, rows in zip(frame["__request"], frame["offered"], strict=True):
                known = [(r["name"], r["description"]) for r in rows]
                name = (call_with_retry(lambda t=text, k=known: selector(t, k), retries) or "").strip()
                chosen.append(name if name in {n for n, _ in known} else None)
            yield pd.DataFrame({"__key": frame["__key"], "__chosen": pd.Series(chosen, dtype=object)})

    answers = lists.mapInPandas(settle, "__key string, __chosen string").where(F.col("__chosen").isNotNull())
    out = routed.join(answers, "__key", "left")
    reason = F.when(F.col("skill").isNull() & F.col("__chosen").isNotNull(), "selector").otherwise(F.col("reason"))
    return out.withColumn("reason", reason).withColumn("skill", F.coalesce("skill", F.when(F.col("reason") == "selector", F.col("__chosen")))).select(*columns, "skill", "reason")


def route_one(spark: SparkSession, request: str, skills: DataFrame) -> tuple[str, str]:
    found = route(spark.createDataFrame([(request,)], "request string"), skills).first()
    if found["skill"] is None:
        raise NoSkill(request, [r["name"] for r in names(skills).collect()], several=True)
    return found["skill"], found["reason"]


def load_attribute(directory: str, reference: str, source: str, package: str | None = None, default: str = "build") -> object:
    """What ``module:attribute`` names: in a package for built-in skills, in the skill's
    folder for a user's.  Running a user's file is the caller's decision to make."""
    module_name, _, attribute = reference.partition(":")
    try:
        if source == "builtin":
            return getattr(importlib.import_module(f"{package}.{module_name}" if package else module_name), attribute or default)
        return folder_attribute(folder_code(directory), module_name, attribute or default)
    except (ImportError, AttributeError, OSError) as error:
        raise BadSkill(f"{reference}: {error}") from error


#: A skill's Python files: module names with their code.
Folder = dict[str, str]


def folder_code(directory: str) -> Folder:
    """The Python files of a folder, read with the file system that owns it."""
    spark = SparkSession.active()
    names = [n for n in files_in(spark, directory) if n.endswith(".py")]
    return {n.removesuffix(".py"): read_text(spark, f"{directory.rstrip('/')}/{n}") for n in names}


class _FolderFinder(importlib.abc.MetaPathFinder, importlib.abc.Loader):
    """Imports modules of folders that came as text, as packages named by what they hold."""

    def __init__(self):
        self.folders: dict[str, Folder] = {}

    def package(self, folder: Folder) -> str:
        """The package of a folder; each is there once a process."""
        name = "quernel_user_" + hashlib.sha256(repr(sorted(folder.items())).encode()).hexdigest()[:32]
        if self not in sys.meta_path:
            sys.meta_path.append(self)
        self.folders[name] = folder
        return name

    def find_spec(self, fullname, path=None, target=None):
        package, _, module = fullname.partition(".")
        if package not in self.folders or module and module not in self.folders[package]:
            return None
        return importlib.util.spec_from_loader(fullname, self, is_package=not module)

    def exec_module(self, module) -> None:
        package, _, name = module.__name__.partition(".")
        if name:
            exec(compile(self.folders[package][name], f"{name}.py", "exec"), module.__dict__)  # noqa: S102


_finder = _FolderFinder()


def folder_attribute(folder: Folder, module: str, attribute: str) -> object:
    """An attribute of a module of the folder; its modules may import each other (``from .other import name``)."""
    if module not in folder:
        raise ImportError(f"{module}.py is not there")
    return getattr(importlib.import_module(f"{_finder.package(folder)}.{module}"), attribute)


def _loader(skill: dict, reference: str, package: str | None) -> Callable[[], object]:
    """A function that executors can run to get an attribute: a user's whole folder travels as text, since they don't have the files."""
    module_name, _, attribute = reference.partition(":")
    attribute = attribute or "build"
    if skill["source"] == "builtin":
        return lambda: load_attribute(skill["directory"], f"{module_name}:{attribute}", "builtin", package)
    folder = folder_code(skill["directory"])
    if module_name not in folder:
        raise BadSkill(f"{skill['name']}: {module_name}.py is not there")
    # By reference: a function of this module is imported on executors, with one finder a process.
    return partial(folder_attribute, folder, module_name, attribute)


def register_skill(spark: SparkSession, skill: dict, name: str, keep: str, fields: str, inputs: Sequence[str] = ("text",), package: str | None = None, retries: int = 2) -> None:
    """A skill as a table function for SQL: ``SELECT * FROM name(TABLE(...))``.

    Of each row of the table it returns the columns of ``keep`` and the ``fields`` (both DDL strings) that the
    skill's program gives for ``inputs``.
    """
    from quernel.plans.reports import as_fields

    made = _loader(skill, skill.get("entrypoint") or "skill:build", package)
    if not callable(made()):
        raise BadSkill(f"{skill['name']}: the entrypoint can't be called")
    kept, given = ([f.name for f in StructType.fromDDL(d)] for d in (keep, fields))

    class SkillRows:
        def __init__(self):
            self.program = made()()

        def eval(self, row):
            got = as_fields(call_with_retry(lambda: self.program(**{k: row[k] for k in inputs}), retries))
            yield (*(row[k] for k in kept), *(got.get(k) for k in given))

    spark.udtf.register(name, F.udtf(SkillRows, returnType=f"{keep}, {fields}"))


def run_skill(rows: DataFrame, skill: dict, fields: str, inputs: Sequence[str] = ("text",), package: str | None = None, retries: int = 2) -> DataFrame:
    """``rows`` with the ``fields`` (a DDL string) that the skill's program gives for each row's ``inputs``.

    The program is made once a batch of rows by the factory that the skill names; it takes
    the inputs by name and returns a mapping, or anything else for a field ``result``.
    """
    from quernel.plans.reports import as_fields

    made = _loader(skill, skill.get("entrypoint") or "skill:build", package)
    if not callable(made()):
        raise BadSkill(f"{skill['name']}: the entrypoint can't be called")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    names = [f.name for f in StructType.fromDDL(fields)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        program = made()()
        for frame in frames:
            got = [as_fields(call_with_retry(lambda v=v: program(**dict(zip(inputs, v, strict=True))), retries)) for v in zip(*(frame[c] for c in inputs), strict=True)]
            yield frame.assign(**{k: [g.get(k) for g in got] for k in names})

    return rows.mapInPandas(run, f"{schema}, {fields}")


def skill_metric(skill: dict, package: str | None = None) -> Callable[[Column, Column], Column] | None:
    """The metric that a skill names as ``skill:attribute`` (in its own code) or ``module:attribute``, a function of
    the structs gold and predicted that returns a Column; None stands for field accuracy."""
    reference = skill.get("metric")
    if not reference:
        return None
    place, _, attribute = reference.partition(":")
    if not attribute:
        raise BadSkill(f"{skill['name']}: a metric is module:attribute")
    own = (skill.get("entrypoint") or "skill:build").partition(":")[0]
    found = _loader(skill, f"{own}:{attribute}", package)() if place == "skill" else load_attribute("", reference, "builtin")
    if not callable(found):
        raise BadSkill(f"{skill['name']}: the metric can't be called")
    return found


def complete(typed: Column, commands: Sequence[str]) -> Column:
    """The commands that begin with what was typed, in their order."""
    return F.filter(F.array(*map(F.lit, commands)), lambda c: c.startswith(typed))


def model_label(model: Column, alias: Column) -> Column:
    """The model to show: the configured one or, failing that, the alias that stands in."""
    return F.coalesce(F.nullif(model, F.lit("")), F.concat(F.lit("(alias "), alias, F.lit(")")))


#: The alias that is always there: a fixed value.
DEFAULT_ALIAS, DEFAULT_MODEL = "default", "local-model"
SPEC = "alias string, model string, ctx int, reasoning string, provider string, priority int"


def model_registry(spark: SparkSession, overrides: dict[str, dict] | None = None, default_model: str | None = None) -> DataFrame:
    """(alias, model, ctx, reasoning, provider): defaults, overrides, then a configured
    default model, which has neither context nor reasoning of its own."""
    rows = [(DEFAULT_ALIAS, DEFAULT_MODEL, None, "nothink", "openai", 0)]
    rows += [(a, o["model"], o.get("ctx"), o.get("reasoning"), o.get("provider", "openai"), 1) for a, o in (overrides or {}).items()]
    if default_model:
        rows.append((DEFAULT_ALIAS, default_model, None, None, "openai", 2))
    return latest_wins(spark.createDataFrame(rows, SPEC), "alias", "priority").drop("priority")


def split_context(model: Column) -> tuple[Column, Column]:
    """A model's name without a trailing ``@number``, and that number."""
    return F.regexp_replace(model, r"@\d+\z", ""), F.regexp_extract(model, r"@(\d+)\z", 1).try_cast("bigint")


def model_string(model: Column, ctx: Column, reasoning: Column, provider: Column, default_reasoning: str = "nothink", ctx_override: Column | None = None) -> Column:
    """``provider/model::reasoning``, and ``@context`` last where one is known."""
    bare, baked = split_context(model)
    context = F.coalesce(*([ctx_override.cast("bigint")] if ctx_override is not None else []), ctx.cast("bigint"), baked)
    return F.concat(provider, F.lit("/"), bare, F.lit("::"), F.coalesce(F.nullif(reasoning, F.lit("")), F.lit(default_reasoning)), F.coalesce(F.concat(F.lit("@"), context.cast("string")), F.lit("")))


def resolve_models(requests: DataFrame, registry: DataFrame, alias: str = "alias", default_reasoning: str = "nothink") -> DataFrame:
    """Add ``model_string`` to rows that name an alias or, failing that, a model."""
    known = registry.withColumnRenamed("alias", "__alias")
    both = requests.join(known, F.col(alias) == F.col("__alias"), "left")
    text = model_string(F.coalesce("model", F.col(alias)), F.col("ctx"), F.col("reasoning"), F.coalesce("provider", F.lit("openai")), default_reasoning)
    return both.withColumn("model_string", text).drop(*known.columns)


def model_aliases(registry: DataFrame, default_reasoning: str = "nothink") -> DataFrame:
    composed = model_string(F.col("model"), F.col("ctx"), F.col("reasoning"), F.col("provider"), default_reasoning)
    return registry.select("alias", composed.alias("model_string")).orderBy("alias")
