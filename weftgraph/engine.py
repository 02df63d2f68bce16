"""The engine: a store, attention per context, and every query, search and change as a method."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.handles import md5
from .operators.accessors import answer_hash, elements
from .operators.attention import Attention, Rates
from .operators.evolution import FITNESS, Evolution
from .operators.linking import CREATORS, Limits, LinkCreator, creation_round, instantiated
from .operators.store import Store
from .plans.compiler import Compiler, QueryOptions, assignment, top_answers
from .plans.patterns import Query, Template, from_tree, parse
from .runtime import discard, exists, stored
from .sources.expressions import load_expressions, load_file, read, show

#: What a query does to attention with the parts of its answers.
CORRELATE_NONE, CORRELATE_HANDLES, CORRELATE_VARIABLES, CORRELATE_BOTH = "none", "handles", "variables", "both"


@dataclass
class Engine:
    spark: SparkSession
    store: Store
    contexts: dict[str, Attention] = field(default_factory=dict)
    rates: Rates = Rates()
    parameters: QueryOptions = QueryOptions()
    #: handle, strength of links; 1 where unknown.
    strengths: DataFrame | None = None
    _cache: dict[tuple, DataFrame] = field(default_factory=dict)

    @staticmethod
    def from_config(spark: SparkSession, config: dict) -> Engine:
        """config: type `file` with path, `tables` with nodes and links paths, `federated` with stores (configs), or `empty`."""
        known = {"file": {"path"}, "tables": {"nodes", "links"}, "federated": {"stores"}, "empty": set()}
        kind = config.get("type")
        if kind not in known or set(config) - {"type"} != known[kind]:
            raise ValueError(f"a store is one of {sorted(known)} with its own keys")
        if kind == "file":
            return Engine(spark, Store(*load_file(spark, config["path"])))
        if kind == "tables":
            return Engine(spark, Store(spark.read.parquet(config["nodes"]), spark.read.parquet(config["links"])))
        if kind == "federated":
            from .operators.store import federated

            return Engine(spark, federated([Engine.from_config(spark, c).store for c in config["stores"]]))
        return Engine(spark, Store.empty(spark))

    # Queries

    def attention(self, context: str = "") -> Attention:
        if context not in self.contexts:
            self.contexts[context] = Attention.empty(self.spark, self.rates)
        return self.contexts[context]

    def query(self, query: Query | str | list[str], options: QueryOptions | None = None, context: str = "", attention_update: bool = False, attention_correlation: str = CORRELATE_NONE) -> DataFrame:
        """The answers as a DataFrame, or with count_only one row of their number (at most max_answers, if that is set)."""
        options = options or self.parameters
        importance = self.contexts[context].importance() if context in self.contexts and not options.disregard_importance else None
        answers = Compiler(self.spark, self.store.links, importance, options).compile(query)
        if options.max_answers:
            answers = top_answers(answers, options.max_answers)
        if attention_update or attention_correlation != CORRELATE_NONE:
            answers = stored(answers, "answers")
        if attention_correlation != CORRELATE_NONE:
            names = {CORRELATE_HANDLES: ["_*"], CORRELATE_VARIABLES: ["$*"], CORRELATE_BOTH: ["_*", "$*"]}[attention_correlation]
            sets = answers.select(F.concat(*[elements(answers, n) for n in names]).alias("handles"))
            self.contexts[context] = self.attention(context).correlate(sets)
        if attention_update:
            held = answers.select(F.explode("handles").alias("handle")).distinct().withColumn("n", F.lit(1))
            self.contexts[context] = self.attention(context).stimulate(held)
        if options.count_only:
            return answers.agg(F.count(F.lit(1)).alias("count"))
        return self.with_expressions(answers) if options.populate_expressions else answers

    def cached(self, query: str, options: QueryOptions | None = None, context: str = "") -> DataFrame:
        """As query(), kept as a table until the store or the context changes; the key holds both, so neither's place is reused."""
        key = (query, options or self.parameters, context, self.store, self.contexts.get(context))
        if key not in self._cache:
            for old in [k for k in self._cache if k[3] is not self.store or k[4] is not self.contexts.get(k[2])]:
                discard(self._cache.pop(old))
            self._cache[key] = stored(self.query(query, options, context), "cached")
        return self._cache[key]

    def with_expressions(self, answers: DataFrame) -> DataFrame:
        """answers with expressions, a map of handles to their expressions."""
        named = answers.withColumn("_answer", answer_hash(answers))
        exprs = self.store.links.select("handle", "expr").unionByName(self.store.nodes.select("handle", F.col("name").alias("expr")))
        # Equal answers have equal parts, so they share a map.
        held = named.select("_answer", F.explode(elements(answers, "*")).alias("handle")).distinct().join(exprs, "handle")
        maps = held.groupBy("_answer").agg(F.map_from_entries(F.collect_set(F.struct("handle", "expr"))).alias("expressions"))
        return named.join(maps, "_answer", "left").drop("_answer")

    def running(self, name: str) -> AbstractContextManager[None]:
        """Within it, all jobs of this thread can be ended by abort(name)."""

        @contextmanager
        def tagged() -> Iterator[None]:
            self.spark.sparkContext.addJobTag(name)
            try:
                yield
            finally:
                self.spark.sparkContext.removeJobTag(name)

        return tagged()

    def abort(self, name: str) -> None:
        self.spark.sparkContext.cancelJobsWithTag(name)

    def stream(self, query: Query | str | list[str], options: QueryOptions | None = None) -> Iterator[dict]:
        """The answers one by one, with assignments as dictionaries."""
        answers = self.query(query, options)
        flat = answers.select("handles", "paths", "importance", "strength", assignment(answers).alias("assignment"))
        for row in flat.toLocalIterator():
            yield row.asDict()

    def set_parameter(self, name: str, value: str) -> None:
        """A query parameter by name, its value as text."""
        kinds = {f.name: type(getattr(self.parameters, f.name)) for f in fields(QueryOptions)}
        if name not in kinds:
            raise ValueError(f"unknown parameter {name}")
        parsed = value == "true" if kinds[name] is bool else kinds[name](value)
        self.parameters = replace(self.parameters, **{name: parsed})

    def command(self, text: str) -> object:
        """`get params`, `set param k v`, `query (...)` or `evolution (...)`."""
        verb, _, rest = text.strip().partition(" ")
        if verb == "get" and rest.strip() == "params":
            return {f.name: getattr(self.parameters, f.name) for f in fields(QueryOptions)}
        if verb == "set":
            _, name, value = rest.split(maxsplit=2)
            return self.set_parameter(name, value)
        if verb == "query":
            return self.query(rest.replace("%", "$") if rest.lstrip().startswith("(") else rest)
        if verb == "evolution":
            return self.evolve(evolution_from_text(rest, self.strengths_or_none()))
        raise ValueError(f"unknown command {verb}")

    def strengths_or_none(self) -> DataFrame:
        """The links' strengths, an empty table if none are known."""
        return self.strengths if self.strengths is not None else self.spark.createDataFrame([], "handle string, strength double")

    # Changes

    def _now(self, store: Store) -> None:
        """The store from now on, as tables, so that changes don't pile up in its plan."""
        self.store = Store(stored(store.nodes, "nodes"), stored(store.links, "links"))

    def load(self, lines: DataFrame) -> None:
        nodes, links = load_expressions(lines)
        self._now(self.store.add_nodes(nodes).add_links(links))

    def set_rates(self, rates: Rates, context: str | None = None) -> None:
        """Rent and spreading rates from now on, of one context or of all and those to come."""
        if context is None:
            self.rates = rates
        for name in [context] if context is not None else list(self.contexts):
            self.contexts[name] = replace(self.attention(name), rates=rates)

    def create_context(
        self, name: str, query: Query | str, determiners: list[tuple[str, str]] | str, stimuli: list[str] | str, rates: Rates | None = None, cache: str | None = None, use_cache: bool = True, recreate: bool = False
    ) -> Attention:
        """A context whose determiners (pairs of accessors, or `a:b,c:d`) and stimuli (accessors, or `a,b`) come from a query's
        answers. cache: a folder that keeps contexts by name; one found there is taken, unless recreate is set."""
        if recreate and not use_cache:
            raise ValueError("a cache that isn't used can't be created anew")
        determiners = schema_pairs(determiners) if isinstance(determiners, str) else determiners
        stimuli = [x for x in stimuli.split(",") if x] if isinstance(stimuli, str) else stimuli
        if rates is not None:
            self.set_rates(rates, name)
        if cache and use_cache and not recreate and exists(self.spark, f"{cache}/{md5(name)}/pool/_SUCCESS"):
            self.load_context(name, cache)
            return self.contexts[name]
        state = self._created(query, determiners, stimuli, rates or self.rates)
        self.contexts[name] = state
        if cache and use_cache:
            self.save_context(name, cache)
        return state

    def _created(self, query: Query | str, determiners: list[tuple[str, str]], stimuli: list[str], rates: Rates) -> Attention:
        answers = stored(self.query(query, QueryOptions(disregard_importance=True, unique_assignment=True)), "answers")
        state = Attention.empty(self.spark, rates)
        for a, b in determiners:
            state = state.set_determiners(answers.select(F.concat(elements(answers, a), elements(answers, b)).alias("handles")))
        if stimuli:
            held = answers.select(F.explode(F.concat(*[elements(answers, s) for s in stimuli])).alias("handle")).distinct()
            new = held.join(state.nodes, "handle", "left_anti").select("handle", F.lit(0).cast("long").alias("cnt"), F.lit(0.0).alias("importance"))
            state = replace(state, nodes=state.nodes.unionByName(new)).stimulate(held.withColumn("n", F.lit(1)))
        return state

    def save_context(self, name: str, folder: str) -> str:
        path = f"{folder}/{md5(name)}"
        self.attention(name).save(path)
        return path

    def load_context(self, name: str, folder: str) -> None:
        self.contexts[name] = Attention.load(self.spark, f"{folder}/{md5(name)}", self.rates)

    def evolve(self, evolution: Evolution, context: str = "", options: QueryOptions | None = None) -> list[dict]:
        found, self.contexts[context] = evolution.run(self.store.links, self.attention(context), options or self.parameters)
        return found

    def create_links(self, query: Query | str, template: Template | str, limit: int = 0) -> DataFrame:
        """Adds the links that a template makes of the answers, and returns the new ones."""
        if isinstance(template, str):
            template = parse(template)
        new = stored(instantiated(self.query(query), template, self.store.links, limit), "created")
        self._now(self.store.add_links(new))
        return new

    def creation_rounds(self, query: Query | str, creator: LinkCreator | str, rounds: int = 1, limits: Limits = Limits(), context: str = "", **arguments: object) -> list[dict[str, int]]:
        """Rounds of link creation by a creator, or by one made from its tag; ends early when a round creates nothing. Keys
        that a round visited are not visited again. Returns each round's counts."""
        if isinstance(creator, str):
            if creator not in CREATORS:
                raise ValueError(f"unknown link creator {creator}")
            creator = CREATORS[creator](**arguments)
        visited, out = self.spark.createDataFrame([], "key string"), []
        for _ in range(rounds):
            new, now, counts = creation_round(self.query(query, context=context), creator, self.store.links, visited, limits)
            out.append(counts)
            visited = stored(visited.unionByName(now), "visited")
            self._now(self.store.add_links(new))
            if not counts["created"]:
                break
        return out


def schema_pairs(text: str) -> list[tuple[str, str]]:
    """`a:b,c:d` as pairs."""
    return [tuple(p.split(":", 1)) for p in text.split(",") if p]


def evolution_from_text(text: str, strengths: DataFrame) -> Evolution:
    """`((query ...) (fitness-function-tag t) (correlation-queries ...) (correlation-replacements ...) (correlation-mappings ...))`,
    heads also q, ff, cq, cr, cm. Replacements and mappings are lists of pairs, one list a correlation query."""
    names = {"q": "query", "ff": "fitness-function-tag", "cq": "correlation-queries", "cr": "correlation-replacements", "cm": "correlation-mappings"}
    parts = {names.get(p[0], p[0]): p[1:] for p in read(text.replace("%", "$"))[0]}
    unknown = set(parts) - set(names.values())
    if unknown or "query" not in parts or "fitness-function-tag" not in parts:
        raise ValueError("an evolution needs a query and a fitness function, and knows " + ", ".join(names.values()))
    tag = parts["fitness-function-tag"][0]
    if tag not in FITNESS:
        raise ValueError(f"unknown fitness function {tag}")
    pairs = lambda trees: [{a: b for a, b in t} for t in trees]
    replaced = [{k.lstrip("$"): v for k, v in d.items()} for d in pairs(parts.get("correlation-replacements", []))]
    queries = [from_tree(t) for t in parts.get("correlation-queries", [])]
    mapped = pairs(parts.get("correlation-mappings", []))
    if not len(queries) == len(replaced) == len(mapped):
        raise ValueError("each correlation query needs its replacements and mappings")
    return Evolution(show(parts["query"][0]), FITNESS[tag](strengths), correlations=list(zip(queries, replaced, mapped, strict=True)))
