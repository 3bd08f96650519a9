"""Cleaned graph tables of a data directory, in DataFrames and in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.functions.ids import trim_ws
from graphloom.operators.normalize import NormalizedEdges, clean_nodes, id_aliases, resolve_aliased, resolved_edges
from graphloom.plans.integrity import _TRIM, repaired, repaired_ref
from graphloom.session import prepared, table


@dataclass
class Graphs:
    """Cleaned tables of a data directory; each is written once per delivery (see ``prepared``) when first used."""

    spark: SparkSession
    d: str

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.d, name)

    def _once(self, name: str, sources: tuple[str, ...], build: Callable[[], DataFrame]) -> DataFrame:
        return prepared(self.spark, name, [f"{self.d}/{s}.parquet" for s in sources], build)

    @cached_property
    def nodes(self) -> DataFrame:
        return self.searched.drop("languageNotes")

    @cached_property
    def searched(self) -> DataFrame:
        """The cleaned nodes with the notes that a search reads besides."""
        return self._once("nodes", ("nodes",), lambda: clean_nodes(self.raw("nodes"), ("languageNotes",)))

    @cached_property
    def aliases(self) -> DataFrame:
        """What the raw ids of deliveries stand for."""
        return self._once("aliases", ("nodes",), lambda: id_aliases(self.raw("nodes")))

    @cached_property
    def normalized(self) -> NormalizedEdges:
        every = self._once("edges", ("nodes", "edges"), lambda: resolved_edges(self.raw("edges"), self.aliases, self.nodes))
        return NormalizedEdges(every.where("reason is null").drop("reason"), every.where("reason is not null").select("graphId", "edge_ord", "source", "target", "type", "reason"))

    @cached_property
    def edges(self) -> DataFrame:
        return self.normalized.edges

    @cached_property
    def members(self) -> DataFrame:
        """graphId, layer_id, layer_ord, pos, id of the living members of the last delivery of each layer."""
        return self._once("members", ("nodes", "layers"), self._members)

    def _members(self) -> DataFrame:
        layers = self.raw("layers").groupBy("graphId", "id").agg(F.max_by(F.struct("nodeIds", "name", "layer_row"), F.struct("arrivedAt", "layer_row")).alias("v"))
        m = layers.select("graphId", F.col("id").alias("layer_id"), F.col("v.name").alias("layer_name"), F.col("v.layer_row").alias("layer_ord"), F.posexplode("v.nodeIds").alias("pos", "ref"))
        m = m.where(trim_ws(F.col("ref")) != "")
        got = resolve_aliased(m, self.aliases, self.nodes)
        return m.join(got.where("ok"), ["graphId", "ref"]).select("graphId", "layer_id", "layer_name", "layer_ord", "pos", F.col("rid").alias("id"))


def values(table_: dict[str, str], name: str) -> str:
    return f"{name}(k, v) as (values {', '.join(f'({k!r}, {v!r})' for k, v in table_.items())})"


BASE = f"""with {values(S.NODE_ALIASES | S.CODE_NODE_ALIASES, 'na')}, {values(S.EDGE_ALIASES | S.CODE_EDGE_ALIASES, 'ea')}, {values(S.NODE_CATEGORY, 'nc')}, {values(S.EDGE_CATEGORY, 'ec')},
{values(S.COMPLEXITY_ALIASES, 'ca')}, {values(S.DIRECTION_ALIASES, 'da')},
nr as (select *, {repaired('id', 'type', 'filePath', 'name')} as rid from nodes where trim(coalesce(id, '')) <> ''),
n as (select graphId, rid as id, case when coalesce(type, '') = '' then 'file' else coalesce(na.v, lower(type)) end as type, name, filePath,
  case when coalesce(summary, '') = '' then coalesce(nullif(name, ''), 'No summary') else summary end as summary, coalesce(tags, []) as tags,
  case when coalesce(complexity, '') = '' then 'moderate' else coalesce(ca.v, lower(complexity)) end as complexity, node_row as node_ord, languageNotes
  from (select * from nr qualify row_number() over (partition by graphId, rid order by arrivedAt desc, node_row desc) = 1) q
  left join na on na.k = lower(type) left join ca on ca.k = lower(complexity) where op <> 'delete'),
al as (select graphId, id as ref, arg_max(rid, (arrivedAt, node_row)) as rid from nr group by 1, 2),
lm0 as (select graphId, id as layer_id, name as layer_name, layer_row as layer_ord, unnest(nodeIds) as ref, generate_subscripts(nodeIds, 1) - 1 as pos from
  (select * from layers qualify row_number() over (partition by graphId, id order by arrivedAt desc, layer_row desc) = 1)),
rf as (select graphId, ref from (select graphId, unnest([source, target]) as ref from edges union select graphId, ref from lm0) where ref is not null),
r1 as (select rf.graphId, rf.ref, coalesce(al.rid, rf.ref) as one from rf left join al using (graphId, ref)),
rs as (select r1.graphId, r1.ref, case when a.id is null and b.id is not null then b.id else r1.one end as rid, a.id is not null or b.id is not null as ok
  from r1 left join n a on a.graphId = r1.graphId and a.id = r1.one left join n b on b.graphId = r1.graphId and b.id = (case when {_TRIM.format(x='r1.one')} = '' then '' else {repaired_ref('r1.one')} end)),
e0 as (select e.graphId, coalesce(s.rid, e.source) as source, coalesce(t.rid, e.target) as target, case when coalesce(e.type, '') = '' then 'depends_on' else coalesce(ea.v, lower(e.type)) end as type,
  case when coalesce(direction, '') = '' then 'forward' else coalesce(da.v, lower(direction)) end as direction,
  greatest(0.0, least(1.0, case when weight is null or isnan(weight) then 0.5 else weight end))::double as weight, edge_row as edge_ord, coalesce(s.ok, false) as s_ok, coalesce(t.ok, false) as t_ok
  from edges e left join rs s on s.graphId = e.graphId and s.ref = e.source left join rs t on t.graphId = e.graphId and t.ref = e.target
  left join ea on ea.k = lower(e.type) left join da on da.k = lower(e.direction)),
e as (select * exclude (s_ok, t_ok) from e0 where s_ok and t_ok qualify row_number() over (partition by graphId, source, target, type order by edge_ord) = 1),
lm as (select m.graphId, layer_id, layer_name, layer_ord, pos, rs.rid as id from lm0 m join rs on rs.graphId = m.graphId and rs.ref = m.ref and rs.ok where trim(m.ref) <> '')
"""
