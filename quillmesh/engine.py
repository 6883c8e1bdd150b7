"""Questions to a compiled corpus, by the names that its users know.

Each method builds a DataFrame plan over the store's tables and returns small results as plain
Python (dicts and lists), as tools do; what can be large stays a DataFrame.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import graph as G
from quillmesh.operators import memory as M
from quillmesh.operators import retrieval as R
from quillmesh.operators.embedding import hashing
from quillmesh.operators.ranking import adjacent_groups, top_per_group
from quillmesh.operators.sqlgate import Gate
from quillmesh.sources import enums as E
from quillmesh.sources.schemas import TABLES
from quillmesh.sources.store import Store

Rerank = Callable[[str, list[dict]], list[dict]]


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Engine:
    """One corpus. model embeds texts (it must be the one that the store was built with); rerank orders results anew."""

    def __init__(self, spark: SparkSession, folder: str, model: Callable[[list[str]], np.ndarray] | None = None, rerank: Rerank | None = None):
        self.spark, self.rerank = spark, rerank
        self.bind_research_dir(folder)
        self.model = model or hashing(int(self.meta().get("vector_dim", 64)))

    def bind_research_dir(self, folder: str) -> dict:
        """Turn to another corpus."""
        self.store = Store(self.spark, folder)
        self.t = {name: self.store.read(name) for name in TABLES}
        return {"research_dir": folder, "compiled": self.store.exists("papers")}

    def meta(self) -> dict[str, str]:
        return {r.key: r.value for r in self.t["meta"].collect()}

    def _absent(self) -> dict | None:
        if not self.store.exists("papers"):
            return {"error": "no corpus", "research_dir": self.store.folder, "hint": "compile one first"}
        return None

    # Papers and atoms

    def paper_summary(self) -> dict:
        if absent := self._absent():
            return absent
        target = self.meta().get("target_paper_id")
        papers = rows(self.t["papers"].filter(F.col("paper_id") == target))
        defined = rows(self.t["atoms"].filter(F.col("defined_by") == target).select("atom_id", "name", "category").orderBy("atom_id"))
        used = self.t["atom_paper_usage"].filter(F.col("paper_id") == target).join(self.t["atoms"], "atom_id").select("atom_id", "name", "category").orderBy("atom_id")
        return {"paper": papers[0] if papers else None, "atoms_defined": defined, "atoms_used": rows(used)}

    def trace_dependency(self, component: str) -> dict:
        categories = [k for k, v in E.CATEGORY_COMPONENT.items() if v == component]
        if not categories:
            return {"error": f"unknown component {component}", "components": sorted(set(E.CATEGORY_COMPONENT.values()))}
        titles = self.t["papers"].select("paper_id", "title")
        atoms = self.t["atoms"].filter(F.col("category").isin(*categories)).join(titles, F.col("defined_by") == F.col("paper_id"), "left").orderBy(F.col("priority").desc(), "atom_id").select("atom_id", "name", "category", "defined_by", "title", "priority")
        role = f"{component}_dependency"
        hit = self.t["edge_roles"].filter(F.col("label") == role).select("edge_id").distinct()
        edges = self.t["edges"].join(hit, "edge_id", "left_semi").orderBy(F.col("confidence").desc(), "edge_id").limit(25).select("edge_id", "from_paper", "to_paper", "confidence")
        return {"component": component, "atoms": rows(atoms), "edges": rows(edges)}

    def find_atom(self, question: str, limit: int = 5) -> list[dict]:
        terms = list(dict.fromkeys(re.findall("[a-z0-9_-]+", question.lower())))
        if not terms:
            return []
        found = R.find_atoms(self.t["atoms"], self.t["atom_evidence"], self.t["atoms_vec"], terms, self._vector(question), limit, question)
        return rows(found.join(self.t["atoms"], "atom_id").orderBy(F.col("score").desc(), "atom_id"))

    def _atom(self, ident: str) -> DataFrame:
        return self.t["atoms"].filter((F.col("atom_id") == ident) | (F.col("atom_uid") == ident))

    def get_evidence(self, atom: str) -> list[dict]:
        spans = self.t["atom_evidence"].join(self._atom(atom).select("atom_id"), "atom_id", "left_semi")
        return rows(spans.join(self.t["papers"].select("paper_id", "title"), "paper_id", "left").orderBy("evidence_id"))

    def list_missing_details(self) -> list[dict]:
        return rows(self.t["missing_details"].orderBy("md_id"))

    def equation_lookup(self, query: str, limit: int = 10) -> list[dict]:
        """% and _ in the query match as in LIKE; case doesn't matter."""
        if not query:
            return []
        pattern = "%" + query.replace("~", "~~") + "%"
        found = self.t["equations"].filter(F.expr("latex ILIKE :p ESCAPE '~'".replace(":p", "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'")))
        return rows(found.join(self.t["papers"].select("paper_id", "title", "rank"), "paper_id", "left").orderBy(F.coalesce("rank", F.lit(0.0)).desc(), "equation_id").limit(limit))

    def compare_methods(self, a: str, b: str) -> dict:
        one, two = rows(self._atom(a)), rows(self._atom(b))
        if not one or not two:
            return {"error": f"no atom {a if not one else b}"}
        users = lambda x: {r.paper_id for r in self.t["atom_paper_usage"].filter(F.col("atom_id") == x).select("paper_id").collect()}
        return {"a": one[0], "b": two[0], "same_category": one[0]["category"] == two[0]["category"], "shared_users": sorted(users(one[0]["atom_id"]) & users(two[0]["atom_id"]))}

    def citation_neighbors(self, paper: str, role: str | None = None) -> list[dict]:
        edges = self.t["edges"]
        if role:
            edges = edges.join(self.t["edge_roles"].filter(F.col("label") == role).select("edge_id").distinct(), "edge_id", "left_semi")
        return rows(G.neighbours(edges, self.t["papers"], paper).orderBy("edge_id"))

    def graph_stats(self) -> dict:
        names = ("papers", "atoms", "atom_evidence", "edges", "missing_details", "chunks", "communities")
        return {n: self.t[n].count() for n in names}

    # Retrieval

    def _vector(self, question: str) -> list[float]:
        return [float(x) for x in self.model([question])[0]]

    def route_query_only(self, question: str) -> str:
        return self.spark.range(1).select(T.route(F.lit(question)).alias("m")).first().m

    def _matches(self, question: str, limit: int) -> R.Matches:
        return R.match(self.t["chunks"], self.t["chunks_vec"], R.question_tokens(question), self._vector(question), limit * R.OVERSAMPLE)

    def _shown(self, found: DataFrame, full: bool) -> list[dict]:
        text = F.col("text") if full else F.substring("text", 1, 240)
        told = found.join(self.t["chunks"].select("chunk_id", "section_id", "chunk_kind", text.alias("text" if full else "snippet")), "chunk_id")
        return rows(told.orderBy(F.col("score").desc(), "chunk_id"))

    def query_chunks(self, question: str, limit: int = 8, full: bool = False, max_per_paper: int = 2, kinds: Sequence[str] | None = None, prefer_kind: str | None = None) -> list[dict]:
        return self._shown(R.query_chunks(self._matches(question, limit), limit, max_per_paper, prefer_kind, kinds), full)

    def query(self, question: str, mode: str = "auto", limit: int = 8, full: bool = False) -> dict:
        route = self.route_query_only(question) if mode == "auto" else mode
        members, terms = self.t["community_papers"], R.question_tokens(question)
        found = self._matches(question, 2 * limit)
        top = R.top_communities(self.t["communities"], self.t["communities_vec"], terms, self._vector(question), 3)
        local = lambda: R.query_local(R.query_chunks(found, 2 * limit, 2 * limit), members, top.orderBy("distance", "community_id").limit(1), limit)
        everywhere = lambda: R.query_global(found, self.t["papers"], self.t["atoms"], members, self.t["community_atoms"], top, limit)
        if route == "global":
            listed = rows(everywhere().orderBy("community_id", "kind", "place"))
            if listed:
                told = rows(self.t["communities"].join(top, "community_id").orderBy("distance", "community_id"))
                return {"mode": "global", "route": route, "communities": told, "items": listed}
            return {"mode": "local", "route": route, "items": self._shown(local(), full)}
        if route == "local":
            items = self._shown(local(), full)
        elif route == "hybrid":
            items = self._shown(R.fuse(local().select("chunk_id", "score"), everywhere(), limit), full)
        else:
            return {"error": f"unknown mode {mode}"}
        return {"mode": route, "route": route, "items": self.rerank(question, items)[:limit] if self.rerank else items}

    def paper_text(self, paper: str, section_type: str | None = None, paragraph_ids: Sequence[str] | None = None, chunk_ids: Sequence[int] | None = None) -> list[dict]:
        """A paper's chunks in order, neighbouring ones of one section together."""
        own = self.t["chunks"].filter(F.col("paper_id") == paper).join(self.t["sections"].select("section_id", F.col("title").alias("section"), "section_type", F.col("ord").alias("section_ord")), "section_id", "left")
        for wanted, column in ((section_type and [section_type], "section_type"), (paragraph_ids, "paragraph_id"), (chunk_ids, "chunk_id")):
            if wanted:
                own = own.filter(F.col(column).isin(*wanted))
        run = adjacent_groups(own, ["paper_id"], [F.col("section_ord").asc_nulls_first(), F.col("ord")], F.col("section"))
        parts = run.groupBy("run").agg(F.first("section").alias("section"), F.array_sort(F.collect_list(F.struct("ord", "chunk_id", "text"))).alias("chunks"))
        return rows(parts.orderBy("run"))

    # Communities and graph

    def list_communities(self) -> list[dict]:
        return rows(self.t["communities"].orderBy(F.col("size").desc(), "community_id"))

    def community_summary(self, community: int) -> dict:
        found = rows(self.t["communities"].filter(F.col("community_id") == community))
        if not found:
            return {"error": f"no community {community}"}
        papers = self.t["community_papers"].filter(F.col("community_id") == community).join(self.t["papers"], "paper_id").orderBy(F.coalesce("rank", F.lit(0.0)).desc(), "paper_id").select("paper_id", "title", "rank")
        atoms = self.t["community_atoms"].filter(F.col("community_id") == community).join(self.t["atoms"], "atom_id").orderBy(F.coalesce("priority", F.lit(0.0)).desc(), "atom_id").select("atom_id", "name", "category")
        return {**found[0], "papers": rows(papers), "atoms": rows(atoms)}

    def graph_sql(self, sql: str, params: Sequence[Any] = (), limit: int = 100) -> dict:
        return Gate(self.spark, self.t).run(sql, params, limit)

    def schema_doc(self) -> str:
        return "\n".join(f"{name}: {schema}" for name, schema in TABLES.items())

    def _edges(self, role: str | None) -> DataFrame:
        return self.t["edges"].filter(F.col("best_role") == role) if role else self.t["edges"]

    def neighborhood_subgraph(self, node: str, hops: int = 2, role_filter: str | None = None, limit: int = 40) -> dict:
        edges = self._edges(role_filter)
        one = edges.select(F.col("from_paper").alias("a"), F.col("to_paper").alias("b")).union(self.t["atoms"].select("defined_by", "atom_id")).union(self.t["atom_paper_usage"].select("paper_id", "atom_id"))
        found = G.breadth_first(one.union(one.select("b", "a")), node, hops, limit)
        nodes = found.select("node")
        inside = edges.join(nodes.toDF("from_paper"), "from_paper", "left_semi").join(nodes.toDF("to_paper"), "to_paper", "left_semi").orderBy("edge_id")
        listed = rows(inside.select("edge_id", "from_paper", "to_paper", "best_role").limit(4 * limit + 1))
        shared = self.t["atom_paper_usage"].join(nodes.toDF("paper_id"), "paper_id", "left_semi").groupBy("atom_id").agg(F.array_sort(F.collect_set("paper_id")).alias("papers")).filter(F.size("papers") >= 2).orderBy("atom_id").limit(30)
        return {"nodes": rows(found.orderBy("hop", "node")), "edges": listed[: 4 * limit], "via_atoms": rows(shared), "truncated": len(listed) > 4 * limit}

    def shortest_path(self, a: str, b: str, max_hops: int = 4, k: int = 3, role_filter: str | None = None) -> dict:
        arcs = G.arcs(self._edges(role_filter), self.t["atoms"], self.t["atom_paper_usage"])
        known = {r.a for r in arcs.filter(F.col("a").isin(a, b)).select("a").distinct().collect()}
        if lost := [x for x in (a, b) if x not in known]:
            return {"error": f"not in the graph: {', '.join(lost)}", "paths": []}
        return {"paths": rows(G.k_shortest(arcs, a, b, k, max_hops))}

    # Context and memory

    def get_paper_context(self) -> dict:
        if absent := self._absent():
            return absent
        by = {r["category"]: r["n"] for r in rows(self.t["atoms"].groupBy("category").agg(F.count("*").alias("n")))}
        hints = [k for k, least in (("method", 5), ("objective", 1), ("procedure", 3), ("theory", 1)) if by.get(k, 0) >= least] or ["mixed"]
        top = rows(self.t["atoms"].orderBy(F.coalesce("priority", F.lit(0.0)).desc(), "atom_id").limit(10).select("atom_id", "name", "category", "priority"))
        return {"stats": self.graph_stats(), "atoms_by_category": by, "top_atoms": top, "hints": hints, "missing": len(self.list_missing_details())}

    def _text(self, name: str) -> DataFrame:
        """Rows (file, text) of a folder of text tables; empty where there is none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.store.folder}/{name}")
        if not path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return self.spark.createDataFrame([], "name string, text string, at string")
        return self.spark.read.schema("name string, text string, at string").json(f"{self.store.folder}/{name}")

    def _append(self, name: str, file: str, text: str, now: str) -> None:
        self.spark.createDataFrame([(file, text, now)], "name string, text string, at string").coalesce(1).write.mode("append").json(f"{self.store.folder}/{name}")

    def record_decision(self, decision: str, reason: str = "", slug: str | None = None, now: dt.datetime | None = None) -> dict:
        """Append to the log of decisions."""
        at = (now or dt.datetime.now(dt.UTC)).strftime("%Y-%m-%dT%H:%MZ")
        name = self.spark.range(1).select(T.slug(F.lit(slug or " ".join(decision.split()[:6]))).alias("s")).first().s
        entry = f"## {at} · {name}\n**Decision:** {decision}\n**Reason:** {reason}\n"
        self._append("decisions", "decisions.md", entry, at)
        return {"timestamp": at, "slug": name}

    def get_decisions_since(self, cutoff: str = "") -> list[dict]:
        found = M.parse_decisions(self._text("decisions"))
        return rows(found.filter(F.col("timestamp") >= cutoff).orderBy("timestamp", "slug"))

    def append_session_note(self, slug: str, section: str, item: str, now: dt.datetime | None = None) -> dict:
        """Add a bullet to a session's section; a session is a day and a slug."""
        moment = now or dt.datetime.now(dt.UTC)
        name = self.spark.range(1).select(T.slug(F.lit(slug), 200, "session").alias("s")).first().s
        file = f"{moment:%Y-%m-%d}-{name}.md"
        self._append("sessions", file, f"## {section}\n- {item}\n", f"{moment:%Y-%m-%dT%H:%M:%S.%fZ}")
        return {"file": file, "section": section}

    def list_sessions(self, limit: int = 5) -> list[dict]:
        notes = self._text("sessions").groupBy("name").agg(F.max("at").alias("at"), F.count("*").alias("bullets"), F.max(F.col("text").startswith("## Next")).alias("next_step"))
        return rows(notes.orderBy(F.col("at").desc(), "name").limit(limit))

    def resume_session(self, name: str | None = None) -> dict:
        """The bullets of a session (the latest by default) by section."""
        every = self._text("sessions")
        if name is None:
            latest = self.list_sessions(1)
            if not latest:
                return {"error": "no session"}
            name = latest[0]["name"]
        out: dict[str, list[str]] = {}
        for r in every.filter(F.col("name") == name).orderBy("at").collect():
            head, _, item = r.text.partition("\n- ")
            out.setdefault(head.removeprefix("## "), []).append(item.rstrip("\n"))
        return {"name": name, "sections": out} if out else {"error": f"no session {name}"}

    def top_chunks(self, per: int = 3) -> DataFrame:
        """The best chunks of each paper."""
        return top_per_group(self.t["chunks"], ["paper_id"], [F.col("quality").desc(), F.col("chunk_id")], per)
