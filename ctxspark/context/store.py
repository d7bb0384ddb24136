"""Conversation contexts on a catalog. Messages are appended as Parquet; atoms, their status and all views are derived."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.context import extract as E
from ctxspark.context import rules as R
from ctxspark.context import view as V
from ctxspark.lang import ast as A
from ctxspark.plans.snapshots import pairs
from ctxspark.sources import catalog as store
from ctxspark.sources.catalog import Catalog, CatalogError

RAW = "context string, ordinal bigint, message_id bigint, speaker string, text string, tab string, auto_tab boolean"
STORED = "context string, ordinal bigint, message_id bigint, speaker string, text string, access_labels array<string>, entities array<string>, suggested_tab string, tab string, tags array<string>, tag_reasons array<string>"


class Contexts:
    def __init__(self, catalog: Catalog):
        self.catalog, self.spark = catalog, catalog.spark
        self._results: dict = {}

    # state

    def _meta(self, name: str) -> dict:
        if name not in self.catalog.state["contexts"]:
            raise CatalogError(f"Unknown context: {name}")
        return self.catalog.state["contexts"][name]

    def messages(self, name: str) -> DataFrame:
        parts = [str(self.catalog.root / p) for p in self._meta(name)["parts"]]
        return self.spark.read.schema(STORED).parquet(*parts) if parts else self.spark.createDataFrame([], STORED)

    def atoms(self, name: str) -> DataFrame:
        return V.with_status(E.exploded(self.messages(name)))

    def _publish(self, name: str, change) -> None:
        state = self.catalog.draft()
        change(state["contexts"].setdefault(name, {"parts": [], "aliases": {}, "next": 0}))
        self.catalog.publish(state)
        self._results.clear()

    def _rewrite(self, name: str, rows: DataFrame, aliases: dict | None = None) -> None:
        path = self.catalog.new_path("contexts", name)
        rows.write.parquet(str(self.catalog.root / path))
        self._publish(name, lambda c: c.update(parts=[path], **({"aliases": aliases} if aliases is not None else {})))

    def _cached(self, key: tuple, make) -> DataFrame:
        """Results of views hold until the catalog changes."""
        key = (self.catalog.revision, *key)
        if key not in self._results:
            self._results = {k: v for k, v in self._results.items() if k[0] == self.catalog.revision}
            self._results[key] = make()
        return self._results[key]

    def resolve(self, name: str, tab: str) -> str:
        frame = self.spark.createDataFrame([(tab,)], "tab string")
        return frame.select(E.resolve_tab(F.col("tab"), self._meta(name)["aliases"])).first()[0]

    # statements

    def create(self, name: str) -> DataFrame:
        if name in self.catalog.state["contexts"]:
            raise CatalogError(f"Context already exists: {name}")
        self._publish(name, lambda c: None)
        return pairs(self.spark, [("context", name), ("schema_registry", R.REGISTRY)])

    def load(self, name: str, raw: DataFrame) -> None:
        """Appends many messages at once, as one more part (beyond a number of parts, they are joined); raw as RAW (context and ordinal apart), in the order of message_id's ordinal."""
        meta = self._meta(name)
        if raw.groupBy("message_id").count().where("count > 1").limit(1).count() or raw.join(self.messages(name), "message_id", "left_semi").limit(1).count():
            raise CatalogError("Duplicate context message id")
        rows = raw.withColumns({"context": F.lit(name), "ordinal": F.col("ordinal") + meta["next"]})
        path = self.catalog.new_path("contexts", name)
        kept = E.messages(rows.select(*[c.split()[0] for c in RAW.split(", ")]), meta["aliases"])
        kept.select(*[c.split()[0] for c in STORED.split(", ")]).write.parquet(str(self.catalog.root / path))
        last = self.spark.read.schema(STORED).parquet(str(self.catalog.root / path)).agg(F.max("ordinal")).first()[0]
        self._publish(name, lambda c: c.update(parts=[*c["parts"], path], next=(last if last is not None else meta["next"] - 1) + 1))
        if len(self._meta(name)["parts"]) > store.MOST_PARTS:
            self._rewrite(name, self.messages(name))

    def append(self, s: A.AppendMemory) -> DataFrame:
        raw = self.spark.createDataFrame([(s.context, 0, s.message_id, s.speaker, s.text, s.tab, s.auto_tab)], RAW)
        if self.messages(s.context).where(F.col("message_id") == s.message_id).limit(1).count():
            raise CatalogError(f"Duplicate context message id: {s.message_id}")
        self.load(s.context, raw)
        source = f"message_{s.message_id}"
        m = self.messages(s.context).where(F.col("message_id") == s.message_id).first()
        suggestion = raw.select(E.tag_suggestions(F.col("text"))[0].alias("s")).first().s
        status = self.atoms(s.context).where((F.col("source") == source) | (F.col("invalidated_by") == source)).orderBy("ordinal", "place").collect()
        own = [a for a in status if a.source == source]
        lost = sum(a.invalidated_by == source for a in status)
        out = [("context", s.context), ("message", source), ("speaker", s.speaker), ("tab", m.tab), ("suggested_tab", suggestion.tag), ("suggested_tab_reason", f"{suggestion.tag} score={suggestion.score} reason={suggestion.reason}"), ("auto_tab", str(s.auto_tab).lower()), ("tags", ",".join(m.tags)), ("tag_reasons", " | ".join(m.tag_reasons)), ("message_schema", "ConversationMessage.v1"), ("access_labels", ",".join(m.access_labels)), ("mentioned_entities", ",".join(m.entities)), ("storage_route", R.STORAGE_ROUTE), ("dcf_object", f"{source} -> ConversationMessage.v1"), ("extracted_atoms", len(own)), ("invalidated_atoms", lost)]
        for a in own:
            out += [("atom", f"{a.key}={a.value} @{a.source}"), ("atom_provenance", f"{a.key} rule={a.rule} confidence={a.confidence} span={a.start}:{a.end}")]
        return pairs(self.spark, out)

    def retag(self, s: A.TagMemory) -> DataFrame:
        rows, aliases = self.messages(s.context), self._meta(s.context)["aliases"]
        hit = F.col("message_id") == s.message_id
        if not rows.where(hit).limit(1).count():
            raise CatalogError(f"Unknown context message id: {s.message_id}")
        tab = self.resolve(s.context, s.tab)
        before = E.resolve_tab(F.col("tab"), aliases)
        tags = F.array_distinct(F.array_append(F.array_remove("tags", before), F.lit(tab)))
        why = F.array_distinct(F.array_append("tag_reasons", F.lit(f"{tab}:100:manual retag")))
        self._rewrite(s.context, rows.withColumns({"tags": F.when(hit, tags).otherwise(F.col("tags")), "tag_reasons": F.when(hit, why).otherwise(F.col("tag_reasons")), "tab": F.when(hit, F.lit(tab)).otherwise(F.col("tab"))}))
        n = self.atoms(s.context).where(F.col("source") == f"message_{s.message_id}").count()
        return pairs(self.spark, [("context", s.context), ("message", f"message_{s.message_id}"), ("tab", tab), ("retagged_atoms", n)])

    def alias(self, s: A.AliasTab) -> DataFrame:
        name = self.spark.createDataFrame([(s.alias,)], "tab string").select(E.normal_tab(F.col("tab"))).first()[0]
        target = self.resolve(s.context, s.target)
        self._publish(s.context, lambda c: c["aliases"].update({name: target}))
        return pairs(self.spark, [("context", s.context), ("alias", name), ("target", target)])

    def merge(self, s: A.MergeTabs) -> DataFrame:
        aliases = dict(self._meta(s.context)["aliases"])
        source, target = self.resolve(s.context, s.source), self.resolve(s.context, s.target)
        moved = atoms = 0
        if source != target:
            rows = self.messages(s.context)
            hit = E.resolve_tab(F.col("tab"), aliases) == source
            moved = rows.where(hit).count()
            atoms = E.exploded(rows.where(hit)).count()
            tags = F.array_sort(F.array_distinct(F.transform("tags", lambda t: F.when(E.resolve_tab(t, aliases) == source, F.lit(target)).otherwise(t))))
            ends = E.resolve_aliases(aliases)
            aliases = {a: target if ends[a] == source else t for a, t in aliases.items()} | {source: target}
            self._rewrite(s.context, rows.withColumns({"tags": tags, "tab": F.when(hit, F.lit(target)).otherwise(F.col("tab"))}), aliases)
        return pairs(self.spark, [("context", s.context), ("from_tab", source), ("to_tab", target), ("moved_messages", moved), ("moved_atoms", atoms)])

    def show_schemas(self) -> DataFrame:
        return schema_registry(self.spark)

    def show_tabs(self, name: str) -> DataFrame:
        return tabs(self.messages(name), self.atoms(name), self._meta(name)["aliases"])

    def show_objects(self, name: str) -> DataFrame:
        return self._cached(("objects", name), lambda: objects(self.messages(name), self.atoms(name), self._meta(name)["aliases"]))

    # views

    def _view(self, s: A.SpillContext):
        aliases = self._meta(s.context)["aliases"]
        tab = self.resolve(s.context, s.tab) if s.tab else ""
        messages, atoms = self.messages(s.context), self.atoms(s.context)
        plan = V.plan_view(atoms, s.query, tab, aliases, s.receipts).withColumn("redacted", F.array_contains("access_labels", R.CONFIDENTIAL))
        taken = V.fill_budget(plan, s.token_budget)
        scope = messages.where(V.matches_tab(tab, aliases))
        seen = scope.select("ordinal", "access_labels", "entities").unionByName(atoms.where(V.matches_tab(tab, aliases)).select("ordinal", "access_labels", F.array().cast("array<string>").alias("entities")))
        labels, entities = (_in_order(seen, c) for c in ("access_labels", "entities"))
        return tab, messages, atoms, plan, taken, ",".join(labels) or R.AGENT_INTERNAL, ",".join(entities), scope

    def spill(self, s: A.SpillContext) -> DataFrame:
        return self._cached(("spill", *vars(s).values()), lambda: self._spill(s))

    def _spill(self, s: A.SpillContext) -> DataFrame:
        tab, messages, atoms, plan, taken, labels, entities, _ = self._view(s)
        rows = taken.orderBy("rank").select("text", "cost", "redacted").collect()  # bounded by the budget
        out = [("context", s.context), ("query", s.query), ("tab", tab or "all"), ("token_budget", s.token_budget), ("token_cost", sum(r.cost for r in rows)), ("messages", messages.count()), ("active_atoms", plan.count()), ("rendered_atoms", len(rows)), ("redacted_atoms", sum(r.redacted for r in rows)), ("schema_registry", R.REGISTRY), ("dcf_storage_route", R.VIEW_ROUTE), ("access_policy", f"schema=agent-internal; labels={labels}; redaction=on"), ("mentioned_entities", entities), ("indexed_fields", "ContextAtom.key,type,status,tab,tags,source,access_labels; ConversationMessage.tab,tags,mentioned_entities,access_labels"), ("current_context", " | ".join(r.text for r in rows))]
        head = pairs(self.spark, out + [("view_atom", r.text) for r in rows])
        if not s.receipts:
            return head
        lost = atoms.where(V.matches_tab(tab, self._meta(s.context)["aliases"]) & (F.col("status") == "invalidated"))
        shown = F.concat("key", F.lit("="), V.redacted(F.col("value"), F.col("access_labels")), F.lit(" @"), "source", F.lit(" invalidated_by="), "invalidated_by")
        return head.unionByName(lost.orderBy("ordinal", "place").select(F.lit("invalidated").alias("field"), shown.alias("value")))

    def explain(self, s: A.ExplainContext) -> DataFrame:
        return self._cached(("explain", *vars(s).values()), lambda: self._explain(s))

    def _explain(self, s: A.ExplainContext) -> DataFrame:
        tab, messages, atoms, plan, taken, labels, entities, scope = self._view(s)
        in_tab = V.matches_tab(tab, self._meta(s.context)["aliases"])
        n_messages, n_scope = messages.count(), scope.count()
        n_atoms, n_in, n_off = atoms.agg(F.count("*"), F.count_if(in_tab), F.count_if(in_tab & (F.col("status") != "active"))).first()
        n_plan, full = plan.agg(F.count("*"), F.coalesce(F.sum("cost"), F.lit(0))).first()
        n_taken, cost, hidden = taken.agg(F.count("*"), F.coalesce(F.sum("cost"), F.lit(0)), F.count_if("redacted")).first()
        out = [("context", s.context), ("thesis", "the prompt is maintained as a relational view"), ("materialized_view", "CURRENT_CONTEXT(context,tab,query,token_budget)"), ("query", s.query), ("tab", tab or "all"), ("token_budget", s.token_budget), ("plan", "Scan messages -> Scan atoms -> Prune tab/status/ACL -> Rank utility+recency -> Budget render -> Emit receipts"), ("scan_messages", f"{n_scope}/{n_messages}"), ("scan_atoms", f"{n_in}/{n_atoms}"), ("pruned_tab_messages", n_messages - n_scope), ("pruned_tab_atoms", n_atoms - n_in), ("pruned_invalidated_atoms", n_off), ("rank_candidates", n_plan), ("rendered_if_spilled", n_taken), ("budget_pruned_atoms", n_plan - n_taken), ("estimated_token_cost", cost), ("estimated_full_token_cost", full), ("optimizer_saved_tokens", max(0, full - cost)), ("redacted_atoms", hidden), ("ranker", "query utility + atom type weights + recency tie-break"), ("context_indexes", "tab,tags,status,key,type,source,access_labels,mentioned_entities"), ("provenance_model", "git-blame-for-prompts: source message, schema, labels, invalidated_by"), ("cache_policy", "revision-aware prompt view IR cache; invalidated on context/catalog mutation"), ("schema_registry", R.REGISTRY), ("dcf_storage_route", R.VIEW_ROUTE), ("access_policy", f"schema=agent-internal; labels={labels}; redaction=on"), ("mentioned_entities", entities)]
        if s.receipts:
            shown = F.concat("key", F.lit("="), V.redacted(F.col("value"), F.col("access_labels")), F.lit(" utility="), F.col("utility").cast("string"), F.lit(" source="), "source")
            out += [("ranked_atom", r[0]) for r in plan.where("rank <= 5").orderBy("rank").select(shown).collect()]
        return pairs(self.spark, out)


def _in_order(rows: DataFrame, column: str) -> list[str]:
    """Distinct values of an array column in order of first appearance; labels and entities are fixed lists."""
    flat = rows.select("ordinal", F.posexplode(column).alias("place", "x")).groupBy("x").agg(F.min(F.struct("ordinal", "place")).alias("first"))
    return [r.x for r in flat.orderBy("first").collect()]


def schema_registry(spark) -> DataFrame:
    return spark.createDataFrame(list(R.SCHEMAS), ", ".join(f"{c} string" for c in R.SCHEMA_COLUMNS))


def objects(messages: DataFrame, atoms: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Messages, then atoms, in one table of 14 text columns; confidential values are redacted."""
    labels = F.array_join("access_labels", ",")
    shown = V.redacted(F.col("text"), F.col("access_labels"))
    m = messages.select(F.concat(F.lit("message_"), F.col("message_id").cast("string")).alias("object_id"), F.lit("ConversationMessage").alias("schema"), F.lit("v1").alias("version"), E.resolve_tab(F.col("tab"), aliases).alias("tab"), F.lit("active").alias("status"), labels.alias("access_labels"), F.lit(R.STORAGE_ROUTE).alias("storage_route"), F.lit("").alias("source"), shown.alias("value"), F.array_join("tags", ",").alias("tags"), F.lit("message").alias("extractor_rule"), F.lit("1.00").alias("extractor_confidence"), F.concat(F.lit("0:"), F.octet_length("text").cast("string")).alias("source_span"), shown.alias("original_snippet"))
    number = F.row_number().over(Window.partitionBy("context").orderBy("ordinal", "place"))
    value = F.concat("type", F.lit(" "), "key", F.lit("="), V.redacted(F.col("value"), F.col("access_labels")))
    a = atoms.select(F.concat(F.lit("atom_"), number.cast("string")).alias("object_id"), F.lit("ContextAtom").alias("schema"), F.lit("v1").alias("version"), E.resolve_tab(F.col("tab"), aliases).alias("tab"), "status", labels.alias("access_labels"), F.lit(R.ATOM_ROUTE).alias("storage_route"), "source", value.alias("value"), F.array_join("tags", ",").alias("tags"), F.col("rule").alias("extractor_rule"), F.col("confidence").alias("extractor_confidence"), F.concat_ws(":", F.col("start").cast("string"), F.col("end").cast("string")).alias("source_span"), V.redacted(F.col("snippet"), F.col("access_labels")).alias("original_snippet"))
    return m.unionByName(a)


def tabs(messages: DataFrame, atoms: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """One row of ten text columns per tab, by name: counts, last message, aliases, labels, tags and reasons. Lists are in
    order of first appearance, messages before atoms. Tabs that only aliases name are there too; none at all is main."""
    spark = messages.sparkSession
    none = F.array().cast("array<string>")
    one = F.lit(1).cast("bigint")
    m = messages.select(E.resolve_tab(F.col("tab"), aliases).alias("tab"), F.lit(0).alias("part"), "ordinal", F.lit(0).alias("place"), one.alias("m"), F.lit(0).alias("a"), F.lit(0).alias("on"), F.lit(0).alias("off"), F.col("message_id").alias("last"), "access_labels", "tags", "tag_reasons")
    a = atoms.select(E.resolve_tab(F.col("tab"), aliases).alias("tab"), F.lit(1).alias("part"), "ordinal", "place", F.lit(0).cast("bigint").alias("m"), F.lit(1).alias("a"), (F.col("status") == "active").cast("int").alias("on"), (F.col("status") == "invalidated").cast("int").alias("off"), F.lit(0).cast("bigint").alias("last"), "access_labels", "tags", none.alias("tag_reasons"))
    every = m.unionByName(a)
    stats = every.groupBy("tab").agg(*[F.sum(c).alias(c) for c in ("m", "a", "on", "off")], F.max("last").alias("last"))

    def listed(column: str, separator: str) -> DataFrame:
        value = E.resolve_tab(F.col("x"), aliases) if column == "tags" else F.col("x")
        flat = every.select("tab", "part", "ordinal", "place", F.posexplode(column).alias("k", "x")).select("tab", value.alias("x"), F.struct("part", "ordinal", "place", "k").alias("at"))
        distinct = flat.groupBy("tab", "x").agg(F.min("at").alias("at"))
        return distinct.groupBy("tab").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda v: v["x"]), separator).alias(column))

    ends = E.resolve_aliases(aliases)
    named = {t: [] for t in ends.values()}
    for alias, t in ends.items():
        named[t].append(alias)
    extra = spark.createDataFrame([(t, ",".join(sorted(x))) for t, x in named.items()], "tab string, aliases string")
    lists = [listed("access_labels", ","), listed("tags", ","), listed("tag_reasons", " | ")]
    out = reduce(lambda p, q: p.join(q, "tab", "left"), lists, stats.join(extra, "tab", "full"))
    if not named:
        out = out.unionByName(spark.createDataFrame([("main",)], "tab string").join(stats.limit(1).select(F.lit(1).alias("z")), F.lit(True), "left_anti"), allowMissingColumns=True)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0")).alias({"m": "messages", "a": "atoms", "on": "active_atoms", "off": "invalidated_atoms"}[c])
    blank = lambda c: F.coalesce(c, F.lit(""))
    return out.select("tab", *[text(c) for c in ("m", "a", "on", "off")], F.when(F.coalesce("last", F.lit(0)) == 0, "").otherwise(F.col("last").cast("string")).alias("last_message"), *[blank(c).alias(c) for c in ("aliases", "access_labels", "tags", "tag_reasons")]).orderBy("tab")

