"""A source tree as one object: parse once, then ask any of the catalogue's questions."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions.text import dirname
from quarrystone.operators import context, crosslang, graph, quality, resolve, search
from quarrystone.session import materialize
from quarrystone.sources import parse, scan
from quarrystone.sources.config import read_config


class Project:
    """Relations and analyses of a folder of source files."""

    def __init__(self, spark: SparkSession, folder: str | None = None, files: DataFrame | None = None, aliases: list[tuple[str, str]] = (), packages: DataFrame | None = None, roots: list[str] | None = None, manifests: DataFrame | None = None):
        """From ``folder``, or from ``files(file, language, content)`` and, for Go and Rust, ``manifests(file, content)``."""
        self.spark, self.packages = spark, packages
        self.config = read_config(folder)
        self.aliases = [*aliases, *self.config.aliases.items()]
        self.sources = files if files is not None else scan.source_files(spark, folder, self.config.max_file_bytes, roots)
        if self.config.ignore:
            steps = F.split(F.regexp_replace("file", "/?[^/]*$", ""), "/")
            self.sources = self.sources.where(~F.arrays_overlap(steps, F.lit(self.config.ignore)))
        self.manifests = manifests if manifests is not None or folder is None else scan.named_files(spark, folder, ("Cargo.toml", "go.mod"), roots=roots)

    @cached_property
    def relations(self) -> parse.Relations:
        return parse.relations(self.sources)

    @property
    def symbols(self) -> DataFrame:
        return self.relations.symbols

    @property
    def files(self) -> DataFrame:
        return self.relations.files

    @cached_property
    def resolved(self) -> DataFrame:
        return materialize(resolve.resolve(self.relations.imports, self.files, self.aliases, self.packages), "resolved")[0]

    @cached_property
    def edges(self) -> DataFrame:
        """Import edges to symbols, or to files for namespace imports."""
        whole = self.resolved.withColumn("is_namespace", F.col("is_namespace") | F.col("is_side_effect"))
        # a Python import of a module by name reaches the file
        module = whole.where(F.col("file").rlike("[.]pyi?$") & ~F.col("is_namespace") & F.col("target").endswith(".py"))
        lost = module.where(F.regexp_extract("target", r"([^/]+)[.]py$", 1) == F.col("symbol")).select(F.col("file").alias("src"), F.col("target").alias("dst"))
        return materialize(graph.wire_imports(whole, self.symbols).unionByName(lost).unionByName(crosslang.edges(self.cross_targets, self.symbols)).distinct(), "edges")[0]

    @cached_property
    def cross_targets(self) -> DataFrame:
        """What imports of packages, namespaces and modules reach."""
        marks = None if self.manifests is None else crosslang.roots(self.manifests)
        return materialize(crosslang.targets(self.relations.imports, self.sources, self.symbols, marks), "crosslang")[0]

    @property
    def file_edges(self) -> DataFrame:
        return graph.file_edges(self.edges, self.symbols)

    @property
    def modules(self) -> DataFrame:
        return self.files.select("file", dirname(F.col("file")).alias("module"))

    def dead_exports(self) -> DataFrame:
        return graph.dead_exports(self.symbols, self.edges)

    def cycles(self, max_length: int = 6) -> DataFrame:
        """Elementary cycles of at most ``max_length`` files; a component of more files is one row besides."""
        return graph.all_cycles(self.file_edges, max_length)

    def coupling(self) -> DataFrame:
        return graph.coupling(self.files, self.file_edges)

    def module_coupling(self) -> DataFrame:
        owner = self.symbols.select(F.col("symbol_id").alias("dst"), F.col("file").alias("__f"))
        raw = self.edges.join(owner, "dst", "left").select("src", F.coalesce("__f", "dst").alias("dst"))
        return graph.module_coupling(raw, self.modules)

    def layer_violations(self, min_gap: float = 0.0) -> DataFrame:
        return graph.layer_violations(self.file_edges, self.coupling(), min_gap)

    def impact(self, symbol: str, compat: bool = False) -> DataFrame:
        """Files that depend on a symbol.  ``compat`` follows symbol ids only: direct importers, then importers of whole files."""
        hit = self.symbols.where((F.col("qualified_name") == symbol) | (F.col("symbol_id") == symbol))
        direct = self.edges.join(hit.select(F.col("symbol_id").alias("dst"), F.col("symbol_id").alias("seed")), "dst").select("seed", F.col("src").alias("file")).distinct()
        further = graph.impact(self.edges if compat else self.file_edges, direct)
        rest = further.select("seed", "file", (F.col("distance") + 1).alias("distance")).join(direct, ["seed", "file"], "left_anti")
        return direct.withColumn("distance", F.lit(1)).unionByName(rest.groupBy("seed", "file").agg(F.min("distance").alias("distance")))

    def complexity(self) -> DataFrame:
        return quality.complexity(self.symbols.where(F.col("kind").isin("function", "method")), self.relations.decisions)

    def smells(self, **limits: int) -> DataFrame:
        return quality.smells(self.files.select("file", "lines"), self.symbols, quality.SMELL_LIMITS | self.config.smells | limits)

    def security(self) -> DataFrame:
        return search.scan_files(self.sources)

    def unused_params(self) -> DataFrame:
        return quality.unused_params(self.relations.params, self.relations.uses)

    def call_graph(self) -> DataFrame:
        named = self.cross_targets.where("not whole").select("file", "symbol", F.lit(None).cast("string").alias("alias"), "target")
        imports = self.resolved.where("target is not null").select("file", "symbol", "alias", "target").unionByName(named)
        whole = self.cross_targets.where("whole").select(F.col("file").alias("src"), F.col("target").alias("dst"))
        return graph.call_graph(self.relations.calls, imports, self.symbols, whole)

    def called_by(self) -> DataFrame:
        return graph.called_by(self.call_graph())

    def languages(self) -> DataFrame:
        return graph.language_breakdown(self.files)

    def outline(self) -> DataFrame:
        return graph.outline(self.symbols)

    def similar(self, at_least: int = 2) -> DataFrame:
        below = self.symbols.groupBy(F.col("parent_id").alias("symbol_id")).agg(F.count(F.lit(1)).alias("n_children"), F.bool_or(F.col("kind").isin("function", "method")).alias("has_nested"))
        rows = self.symbols.where(F.col("kind").isin("function", "method", "class", "struct")).join(below, "symbol_id", "left").na.fill(0, ["n_children"]).na.fill(False, ["has_nested"])
        return search.similar_groups(rows, search.symbol_shape(), at_least, "symbol_id")

    def find(self, query: str, k: int = 20) -> DataFrame:
        return search.semantic_search(self.symbols, query, k)

    def test_map(self) -> DataFrame:
        return quality.test_map(self.files, self.file_edges)

    def metrics(self) -> DataFrame:
        """The report's one row: counts, score and grade."""
        n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
        cx = self.complexity()
        tops = graph.top_symbols(self.edges, self.symbols, 8)
        row = (
            n(self.files, "files").crossJoin(n(self.symbols, "symbols")).crossJoin(n(self.dead_exports().where("confidence = 'high'"), "dead")).crossJoin(n(self.cycles(), "cycles"))
            .crossJoin(cx.agg(F.count_if(F.col("complexity") > 20).alias("very_high"), F.count_if(F.col("complexity").between(11, 20)).alias("high"), F.coalesce(F.max("complexity"), F.lit(0)).alias("max_complexity")))
            .crossJoin(tops.agg(F.count_if(F.col("import_count") >= 8).alias("god_nodes"))).crossJoin(n(self.layer_violations(), "sdp"))
            .crossJoin(quality.coverage_summary(self.files, self.test_map()).select(F.col("ratio").alias("coverage")))
        )
        return quality.health_score(row)

    def gate(self, thresholds: dict[str, float] | None = None, baseline: DataFrame | None = None) -> DataFrame:
        return quality.quality_gate(self.metrics(), self.config.gate | (thresholds or {}), baseline)

    def rules(self, **limits: float) -> DataFrame:
        """Files above the limits of lines, imports and exports."""
        n = lambda df, name: df.groupBy("file").agg(F.count(F.lit(1)).alias(name))
        counts = self.files.select("file", "lines").join(n(self.relations.imports, "imports"), "file", "left").join(n(self.symbols.where("exported"), "exports"), "file", "left").na.fill(0)
        return quality.general_rules(counts, quality.FILE_LIMITS | self.config.rules | limits)

    def arch(self, rules: list[dict] = ()) -> DataFrame:
        """Violations of glob rules: those given and those of the settings."""
        return graph.arch_rules(self.file_edges, [*rules, *self.config.arch])

    def fixes(self, max_priority: int = 3) -> DataFrame:
        found = self.security().select("file", "rule", F.col("line_no").cast("int").alias("line_no"))
        found = found.unionByName(self.smells().select("file", F.col("smell").alias("rule"), F.lit(None).cast("int").alias("line_no")))
        return quality.fix_suggestions(found.unionByName(self.dead_exports().select("file", F.lit("dead-export").alias("rule"), F.lit(None).cast("int").alias("line_no"))), max_priority)

    def explain(self, name: str) -> DataFrame:
        return context.explain(self.symbols, self.edges, self.relations.calls, self.complexity(), name)

    def pack(self, symbol_id: str) -> DataFrame:
        return context.context_pack(self.symbols, self.sources, self.edges, self.file_edges, symbol_id)
