"""Facts that generators and program augmentation add: edges, sources, modes and call sequences.

Each operator takes tables and parameters and returns rows to union with what is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.joins import BLOCKS, dealt_join, split_single

#: Overrides from which calls are not joined, in general and for platform classes.
JOIN_LIMIT, PLATFORM_LIMIT = 40, 10

# Types whose casts are tagged, by the feature's ending.
CAST_TYPES = {"numeric": ["B", "S", "I", "J", "F", "D"], "boolean": ["Z"], "uri": ["Landroid/net/Uri;"]}
# Names by which a method without code sets what it is given.
SETTER_PREFIXES = ["add", "set", "put", "append", "with"]


def outer_class(name: Column) -> Column:
    """A class without its inner levels: ``La/B$C$D;`` is ``La/B;``."""
    return F.regexp_replace(name, r"\$[^;]*", "")


def with_shims(edges: DataFrame, shims: DataFrame, methods: DataFrame) -> DataFrame:
    """``edges(a, b)`` with ``call_kind``: a call of a shimmed method also calls the methods of the
    class and name that ``shims(shimmed, class, name)`` gives."""
    named = methods.join(shims.select("class", "name").distinct(), ["class", "name"], "left_semi")
    called = edges.join(shims, F.col("b") == F.col("shimmed")).select("a", "b", "class", "name")
    added = dealt_join(called, named.select("class", "name", F.col("method_id").alias("target")), ["class", "name"], ["a", "b"])
    return edges.select("a", "b", F.lit("Normal").alias("call_kind")).unionByName(added.select("a", F.col("target").alias("b"), F.lit("Shim").alias("call_kind")))


def type_shims(sites: DataFrame, shims: DataFrame, arguments: DataFrame, methods: DataFrame) -> DataFrame:
    """(site, target): for ``shims(shimmed, argument, name)`` the method of that name in the type of
    the call's argument, for ``sites(site, callee)`` and ``arguments(site, argument, type)``."""
    called = sites.join(shims, F.col("callee") == F.col("shimmed")).join(arguments, ["site", "argument"]).select("site", "type", "name").distinct()
    targets = methods.select(F.col("method_id").alias("target"), F.col("class").alias("type"), "name")
    once, more = (dealt_join(called, part, ["type", "name"], ["site"]).select("site", "target") for part in split_single(targets, "target", ["type", "name"]))
    return once.unionByName(more.distinct())


def anonymous_calls(arguments: DataFrame, types: DataFrame, methods: DataFrame) -> DataFrame:
    """(caller, callee): a caller that passes an object of an anonymous class may lead to any of
    its virtual methods.  ``arguments(caller, type)``, ``types(type, anonymous)``."""
    passed = arguments.join(types.where("anonymous").select("type"), "type").distinct()
    passed = passed.select("caller", "type")
    virtual = methods.where("NOT is_static").select(F.col("method_id").alias("callee"), F.col("class").alias("type"))
    virtual = virtual.join(types.where("anonymous").select("type").distinct(), "type", "left_semi")
    # few types, each with many callers and many methods
    once, more = (dealt_join(passed, part, ["type"], ["caller"], 32 * BLOCKS).select("caller", "callee") for part in split_single(virtual, "callee", ["type"]))
    return once.unionByName(more.distinct())


def route_intents(sends: DataFrame, receivers: DataFrame, on: list[str]) -> DataFrame:
    """(sender, receiver): send points and the components that receive for their target."""
    return sends.select("sender", *on).distinct().join(receivers.select("receiver", *on).distinct(), on).select("sender", "receiver").distinct()


def exported_sources(methods: DataFrame, components: DataFrame, kind: str = "Exploitability") -> DataFrame:
    """(method_id, kind, feature): methods, but private ones, of exported components without a
    permission and of their inner classes.  ``components(class, exported, permission)``."""
    open_ = components.where("exported AND permission IS NULL").select(F.col("class").alias("component")).distinct()
    found = methods.join(open_, outer_class(F.col("class")) == F.col("component")).where("visibility <> 'private'")
    return found.select("method_id", F.lit(kind).alias("kind"), F.concat(F.lit("via-"), F.lower("package")).alias("feature"))


def callback_sources(methods: DataFrame, classes: DataFrame, callbacks: list[str], argument: int) -> DataFrame:
    """(method_id, port): callbacks of ``classes(class)`` whose argument becomes a source: what a
    receiver gets once it is registered, or a service once it is in the manifest."""
    found = methods.join(classes.select("class").distinct(), "class").where(F.col("name").isin(callbacks) & (F.col("n_params") >= argument))
    return found.select("method_id", F.lit(f"Argument({argument})").alias("port"))


def registering_classes(methods: DataFrame, edges: DataFrame, registers: Column) -> DataFrame:
    """(class): classes with a method that calls a registering one."""
    register = methods.where(registers).select(F.col("method_id").alias("b"))
    callers = edges.join(register, "b", "left_semi").select(F.col("a").alias("method_id")).distinct()
    return methods.join(callers, "method_id", "left_semi").select("class").distinct()


def provider_models(methods: DataFrame, providers: DataFrame, operations: str, secure: DataFrame | None = None) -> DataFrame:
    """(method_id, role, port): operations of content providers (``providers(class)``, those under a
    ``secure(class)`` left out): every argument is a source, the result a sink."""
    if secure is not None:
        providers = providers.join(secure, "class", "left_anti")
    found = methods.join(providers.select("class").distinct(), "class").where(F.col("name").rlike(f"^(?:{operations})$"))
    sources = found.where("n_params > 0").select("method_id", F.lit("parameter_sources").alias("role"), F.explode(F.sequence(F.lit(1), "n_params")).alias("i")).select("method_id", "role", F.format_string("Argument(%d)", "i").alias("port"))
    return sources.unionByName(found.select("method_id", F.lit("sinks").alias("role"), F.lit("Return").alias("port")))


def linked_sources(methods: DataFrame, annotated: DataFrame) -> DataFrame:
    """(method_id, kind, port): methods, but private ones, of classes that an annotation of
    ``annotated(class, value)`` opens to links."""
    return methods.join(annotated.select("class").distinct(), "class").where("visibility <> 'private'").select("method_id", F.lit("DeepLink").alias("kind"), F.lit("Argument(1)").alias("port"))


def pass_through(methods: DataFrame, skipped: list[str], returned: str | None = None) -> DataFrame:
    """(method_id, input, output, feature): methods without code pass every argument to their
    result.  With ``returned``, a column of return types, casts are tagged and void ones left out."""
    bare = methods.where(~F.col("has_code") & ~F.col("name").isin(skipped) & (F.col("n_params") > 0))
    tags = F.array(F.lit("via-obscure-taint-in-taint-out"))
    if returned is not None:
        bare = bare.where(F.col(returned) != "V")
        for ending, types in CAST_TYPES.items():
            tags = F.when(F.col(returned).isin(types), F.concat(tags, F.array(F.lit(f"cast:{ending}")))).otherwise(tags)
    ports = bare.select("method_id", F.explode(F.sequence(F.lit(0), F.col("n_params") - 1)).alias("i"), tags.alias("features"))
    return ports.select("method_id", F.format_string("Argument(%d)", "i").alias("input"), F.lit("Return").alias("output"), F.explode("features").alias("feature"))


def setters(methods: DataFrame, prefixes: list[str] = SETTER_PREFIXES, builder: str = "$Builder;") -> DataFrame:
    """(method_id, input, output): methods without code that set by their name, or of a builder,
    pass every argument to their object."""
    named = F.col("name").rlike("^(?:" + "|".join(prefixes) + ")")
    bare = methods.where(~F.col("has_code") & ~F.col("is_static") & (named | F.col("class").endswith(builder)) & (F.col("n_params") > 0))
    return bare.select("method_id", F.explode(F.sequence(F.lit(1), "n_params")).alias("i")).select("method_id", F.format_string("Argument(%d)", "i").alias("input"), F.lit("Argument(0)").alias("output"))


def returns_this(returned: DataFrame) -> DataFrame:
    """(method): builders, all of whose results are their own object; ``returned(method, node)``."""
    return returned.groupBy("method").agg(F.bool_and(F.col("node") == "this").alias("own")).where("own").select("method")


def join_modes(counts: DataFrame, platform: Column, limit: int = JOIN_LIMIT, platform_limit: int = PLATFORM_LIMIT) -> DataFrame:
    """``counts(..., n)`` of overrides with ``no_join``: too many to be joined at a call."""
    return counts.withColumn("no_join", F.col("n") >= F.when(platform, platform_limit).otherwise(limit))


def leaf_types(types: DataFrame) -> DataFrame:
    """(type): types without a descendant."""
    return types.join(types.select(F.col("super").alias("type")).distinct(), "type", "left_anti").select("type")


def lifecycle_steps(declared: DataFrame, steps: DataFrame, least: int = 2) -> DataFrame:
    """(cls, step, callback): classes with at least ``least`` of a lifecycle's callbacks, which are
    called in the order of ``steps(i, callback)``; ``declared(cls, callback)`` is distinct."""
    held = declared.join(F.broadcast(steps), "callback")  # a parameter: the steps of one lifecycle
    enough = held.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("cls")
    return held.join(enough, "cls").select("cls", F.row_number().over(Window.partitionBy("cls").orderBy("i")).alias("step"), "callback")


def lifecycle_graph(declared: DataFrame, graph: list[tuple[str, str]]) -> DataFrame:
    """(cls, a, b): the calls of a lifecycle graph between callbacks that a class declares; what it
    does not declare is passed over.  ``graph`` is a parameter of a few dozen pairs."""
    spark = declared.sparkSession
    edges = F.broadcast(spark.createDataFrame(graph, "a string, b string"))
    classes = declared.select("cls").distinct()
    there = declared.select("cls", F.col("callback").alias("at"), F.lit(True).alias("has"))
    open_ = classes.crossJoin(edges)  # a class has all pairs of the graph, which is a parameter
    done = None
    for _ in range(len({n for pair in graph for n in pair}) + 1):
        ends = open_.join(there.withColumnRenamed("at", "b"), ["cls", "b"], "left").select("cls", "a", "b", F.coalesce("has", F.lit(False)).alias("has"))
        found = ends.where("has").select("cls", "a", "b").distinct()
        done = found if done is None else done.unionByName(found).distinct()
        further = edges.toDF("mid", "to")
        open_ = ends.where("NOT has").join(further, F.col("b") == F.col("mid")).select("cls", "a", F.col("to").alias("b")).distinct()
    return done.join(there.withColumnRenamed("at", "a").drop("has"), ["cls", "a"], "left_semi").select("cls", "a", "b")
