"""Queries over the temporal knowledge graph, its embeddings and its hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagraph.functions.columns import dot, norm, normalised
from stratagraph.operators import blocks, descent, features, graph, hyperbolic as hyp, kg, projection, scoring
from stratagraph.plans.registry import query
from stratagraph.sources import tables
from stratagraph.sources.steps import step

YEARS = 7
FACTS_SQL = """
fl AS (SELECT 'n:'||n_name AS h, o_orderpriority AS r, 'b:'||p_brand AS t, year(o_orderdate)-1995 AS y FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN part ON l_partkey=p_partkey),
facts AS (SELECT h, r, t, min(y)::INTEGER AS tb, CASE WHEN max(y)>=5 AND t<'b:Brand#3' THEN NULL ELSE max(y) END::INTEGER AS te FROM fl GROUP BY h, r, t
  UNION ALL SELECT 'n:'||n_name, 'in_region', 'g:'||r_name, NULL, NULL FROM nation JOIN region ON n_regionkey=r_regionkey),
ent AS (SELECT name, (row_number() OVER (ORDER BY name)-1)::INTEGER AS id FROM (SELECT h AS name FROM facts UNION SELECT t FROM facts)),
rel AS (SELECT name, (row_number() OVER (ORDER BY name)-1)::INTEGER AS id FROM (SELECT DISTINCT r AS name FROM facts)),
spans AS (SELECT h, r, t, CASE WHEN tb IS NULL AND te IS NULL THEN 0 ELSE greatest(coalesce(tb,0),0) END AS lo, least(coalesce(te,6),6) AS hi FROM facts),
named AS (SELECT h, r, t, tau::INTEGER AS tau FROM (SELECT h, r, t, unnest(generate_series(lo,hi)) AS tau FROM spans WHERE lo<=hi)),
quads AS (SELECT a.id AS h, b.id AS r, c.id AS t, tau FROM named JOIN ent a ON a.name=h JOIN rel b ON b.name=r JOIN ent c ON c.name=t)
"""
K = "WITH " + FACTS_SQL


def facts(spark, d):
    """Sales as facts: which nation ordered a brand at a priority, from the first year to the last or still open; nations in regions hold always."""
    s = tables.sales(spark, d).select(F.col("nation").alias("h"), F.col("priority").alias("r"), F.col("brand").alias("t"), (F.col("year") - tables.FIRST_YEAR).alias("y"))
    dated = s.groupBy("h", "r", "t").agg(F.min("y").cast("int").alias("tb"), F.max("y").alias("m")).select("h", "r", "t", "tb", F.when((F.col("m") >= 5) & (F.col("t") < "b:Brand#3"), None).otherwise(F.col("m")).cast("int").alias("te"))
    where = tables.read(spark, d, "nation").join(tables.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    null = F.lit(None).cast("int")
    return dated.unionByName(where.select(F.concat(F.lit("n:"), "n_name").alias("h"), F.lit("in_region").alias("r"), F.concat(F.lit("g:"), "r_name").alias("t"), null.alias("tb"), null.alias("te")))


class Graph:
    def __init__(self, spark, d):
        self.facts = step(facts(spark, d))
        self.entities, self.relations = step(kg.entity_ids(self.facts)), step(kg.relation_ids(self.facts))
        self.quads = kg.encode(kg.expand_intervals(self.facts, YEARS), self.entities, self.relations)


@query(K + " SELECT h, r, t, coalesce(tb,-1)::INTEGER AS tb, coalesce(te,-1)::INTEGER AS te FROM facts")
def kg_facts(spark, d):
    """Facts with -1 for an end that is not there."""
    return facts(spark, d).na.fill(-1, ["tb", "te"])


@query(K + " SELECT name, id FROM ent")
def entity_ids(spark, d):
    return kg.entity_ids(facts(spark, d))


@query(K + " SELECT name, id FROM rel")
def relation_ids(spark, d):
    return kg.relation_ids(facts(spark, d))


@query(K + " SELECT h, r, t, tau FROM quads")
def interval_expand(spark, d):
    return Graph(spark, d).quads


@query(K + " SELECT CASE WHEN tau<=4 THEN 'train' WHEN tau=5 THEN 'valid' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT (h,r,t,tau)) AS n_distinct FROM quads GROUP BY ALL")
def temporal_split(spark, d):
    q = Graph(spark, d).quads.withColumn("split", kg.split_label(F.col("tau"), 4, 5, 6))
    return q.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("h", "r", "t", "tau").alias("n_distinct"))


@query(K + " SELECT h, r, t, tau, CASE WHEN h=3 OR t=3 THEN 'test' ELSE 'train' END AS split FROM quads WHERE h=3 OR t=3 OR tau<=4")
def loo_split(spark, d):
    return kg.leave_one_out(Graph(spark, d).quads, F.lit(3), 4)


@query("SELECT a.c_custkey AS customer, b.band, a.lo, a.hi FROM (SELECT c_custkey, (floor(c_acctbal/100)*100)::BIGINT AS lo, (floor(c_acctbal/100)*100+c_custkey%7*150)::BIGINT AS hi FROM customer) a JOIN (SELECT ('band'||i) AS band, (i*2000-2000)::BIGINT AS lo, (i*2000)::BIGINT AS hi FROM range(0,7) t(i)) b ON a.lo<=b.hi AND a.hi>=b.lo")
def interval_overlap(spark, d):
    c = tables.read(spark, d, "customer").select(F.col("c_custkey").alias("customer"), (F.floor(F.col("c_acctbal") / 100) * 100).cast("long").alias("lo"), (F.floor(F.col("c_acctbal") / 100) * 100 + F.col("c_custkey") % 7 * 150).cast("long").alias("hi"))
    bands = spark.range(7).select(F.concat(F.lit("band"), F.col("id")).alias("band"), (F.col("id") * 2000 - 2000).alias("lo"), (F.col("id") * 2000).alias("hi"))
    return kg.interval_join(c, bands, 1000).select(F.col("a_customer").alias("customer"), F.col("b_band").alias("band"), F.col("a_lo").alias("lo"), F.col("a_hi").alias("hi"))


@query(K + " SELECT h, coalesce(bool_or(r='1-URGENT' AND tb IS NOT NULL AND tb<=2 AND (te IS NULL OR te>=2)),false) AS deployed FROM facts GROUP BY h")
def interval_stab_deployed(spark, d):
    f = facts(spark, d)
    return kg.deployed_at(f, f.select("h").distinct(), "1-URGENT", 2)


PROB_SQL = FACTS_SQL + ", tc AS (SELECT id, count(q.t)::BIGINT AS n FROM ent LEFT JOIN quads q ON q.t=ent.id GROUP BY id), pr AS (SELECT id, n, pow(n+1,0.75)/sum(pow(n+1,0.75)) OVER () AS p FROM tc)"


@query("WITH " + PROB_SQL + " SELECT id, n, round(p,8) AS p FROM pr")
def neg_sampling_prob(spark, d):
    g = Graph(spark, d)
    return kg.negative_probabilities(g.quads, g.entities).withColumn("p", F.round("p", 8))


@query("WITH " + PROB_SQL + """, cum AS (SELECT id, sum(p) OVER (ORDER BY id) AS hi FROM pr), pos AS (SELECT (((tau*nr+r)*ne+h)*ne+t)::BIGINT AS pos_id FROM quads, (SELECT (SELECT count(*) FROM ent) AS ne, (SELECT count(*) FROM rel) AS nr)), dr AS (SELECT pos_id, j::INTEGER AS j, ((((((pos_id*4+j)%2147483648+7919*((pos_id*4+j)//2147483648))%2147483648*1103515245+12345)%2147483648)*1103515245+12345)%2147483648)/2147483648.0::DOUBLE AS u FROM pos, range(0,4) t(j)),
iv AS (SELECT id, hi, lag(hi, 1, 0.0::DOUBLE) OVER (ORDER BY id) AS lo FROM cum)
SELECT pos_id, j, id::INTEGER AS neg FROM dr JOIN iv ON u>=lo AND u<hi""")
def negative_samples(spark, d):
    g = Graph(spark, d)
    n_e, n_r = g.entities.count(), g.relations.count()
    pos = g.quads.select((((F.col("tau").cast("long") * n_r + F.col("r")) * n_e + F.col("h")) * n_e + F.col("t")).alias("pos_id"))
    return kg.negative_samples(pos, kg.negative_probabilities(g.quads, g.entities), 4)


def emb(spark, d):
    """``id, re, im`` from the two halves of the embeddings."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    return tables.read(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("id"), F.slice(v, 1, 32).alias("re"), F.slice(v, 33, 32).alias("im"))


#: Vectors by key: entities, relations and points in time, numbered one after another, take the vectors of these numbers, modulo how many there are.
VECTORS_SQL = FACTS_SQL + """,
x AS (SELECT vec_id::INTEGER AS id, k, embedding[k]::DOUBLE AS re, embedding[k+32]::DOUBLE AS im FROM embeddings, range(1,33) g(k)),
base AS (SELECT (SELECT count(*) FROM ent) AS ne, (SELECT count(*) FROM rel) AS nr, (SELECT count(*) FROM embeddings) AS nv),
xe AS (SELECT ent.id, name, k, re, im FROM ent CROSS JOIN base JOIN x ON x.id=ent.id%nv),
xr AS (SELECT rel.id, name, k, re, im FROM rel CROSS JOIN base JOIN x ON x.id=(ne+rel.id)%nv),
xt AS (SELECT tau::INTEGER AS tau, k, re, im FROM range(0,7) u(tau) CROSS JOIN base JOIN x ON x.id=(ne+nr+tau)%nv)"""
PARTS_SQL = "h.re AS hr, h.im AS hi, r.re AS rr, r.im AS ri, v.re AS vr, v.im AS vi, t.re AS tr, t.im AS ti"
#: A stated query set, every vector whose id is divisible by 20 as head with all relations and two points in time, against all vectors as tails.
SCORED_SQL = VECTORS_SQL + ", z AS (SELECT h.id AS h, r.id AS r, v.tau, t.id AS t, h.k, " + PARTS_SQL + " FROM x h JOIN xr r ON r.k=h.k JOIN xt v ON v.k=h.k AND v.tau IN (1,6) JOIN x t ON t.k=h.k WHERE h.id%20=0)"
#: Every nation, relation and year with every entity as tail.
KNOWN_SQL = VECTORS_SQL + ", z AS (SELECT h.id AS h, h.name AS hn, r.id AS r, r.name AS rn, v.tau, t.id AS t, t.name AS tn, " + PARTS_SQL + " FROM xe h JOIN xr r ON r.k=h.k JOIN xt v ON v.k=h.k JOIN xe t ON t.k=h.k WHERE h.name LIKE 'n:%')"
S = "WITH " + SCORED_SQL
TC = "sum((hr*(rr+vr)-hi*(ri+vi))*tr+(hr*(ri+vi)+hi*(rr+vr))*ti)"


def all_of(score: str) -> str:
    return S + f" SELECT h, r, tau, t, round({score},6)+0.0::DOUBLE AS score FROM z GROUP BY h, r, tau, t"


class Vectors(Graph):
    """A graph whose names and times have vectors, gathered by key from all embeddings."""

    def __init__(self, spark, d):
        super().__init__(spark, d)
        self.emb = emb(spark, d)
        n_e, n_r, n = self.entities.count(), self.relations.count(), self.emb.count()

        def gather(keys, key, start, rows):
            # written, in partitions by its own rows: products of these tables would multiply the partitions of all embeddings
            found = keys.withColumn("_v", (F.col(key) + start) % n).join(self.emb.withColumnRenamed("id", "_v"), "_v").drop("_v")
            return step(found.repartition(max(1, -(-rows // blocks.QUERIES))))

        self.e, self.r = gather(self.entities, "id", 0, n_e), gather(self.relations, "id", n_e, n_r)
        self.t = gather(spark.range(YEARS).select(F.col("id").cast("int").alias("tau")), "tau", n_e + n_r, YEARS)

    def queries(self, model, heads, times=None, relations=None):
        """``h, r, tau, q``: heads (``id, re, im``) with relations and times, folded into one vector each before any tail is met."""
        part = lambda df, key, p: df.select(F.col(key).alias(p), F.col("re").alias(f"{p}_re"), F.col("im").alias(f"{p}_im"))
        t = self.t if times is None else self.t.where(F.col("tau").isin(*times))
        rows = part(heads, "id", "h").crossJoin(part(self.r if relations is None else relations, "id", "r")).crossJoin(part(t, "tau", "tau"))
        return rows.select("h", "r", "tau", scoring.query_vector(model, "h_re", "h_im", "r_re", "r_im", "tau_re", "tau_im").alias("q"))

    @property
    def nations(self):
        return self.e.where(F.col("name").startswith("n:"))

    def names(self, rows, **columns):
        return kg.decode(rows, self.entities, columns)


def unit(v):
    """At unit length. The length is bound once; inside the lambda of the places it would be made anew for each of them."""
    return F.transform(F.array(norm(v) + 1e-12), lambda n: F.transform(v, lambda x: x / n))[0]


def tails(model, vectors):
    return vectors.select("id", scoring.tail_vector(model, F.col("re"), F.col("im")).alias("c"))


def answers(g, model, candidates, k=None):
    """The k best tails of every query of the stated set, or all. A model without time answers each head and relation once, for both points in time."""
    heads, times = g.emb.where("id % 20 = 0"), (1, 6)

    def found(keys, times):
        sides = g.queries(model, heads, times), keys, candidates
        return blocks.best(*sides, k, scoring.TAIL_SCORES[model]) if k else blocks.every(*sides, scoring.TAIL_SCORES[model])

    if model in scoring.TIMED:
        return found(["h", "r", "tau"], times).withColumnRenamed("id", "t")
    return found(["h", "r"], times[:1]).select("h", "r", F.explode(F.array(*[F.lit(t).cast("long") for t in times])).alias("tau"), F.col("id").alias("t"), "score")


def scored(spark, d, model):
    g = Vectors(spark, d)
    return answers(g, model, tails(model, g.emb))


@query(all_of(TC))
def score_tcomplex(spark, d):
    """All vectors as tails of every query of the stated set."""
    return scored(spark, d, "tcomplex")


@query(all_of("sum((hr*rr-hi*ri)*tr+(hr*ri+hi*rr)*ti)"))
def score_complex(spark, d):
    return scored(spark, d, "complex")


@query(all_of("sum(hr*rr*tr)"))
def score_distmult(spark, d):
    return scored(spark, d, "distmult")


@query(all_of("-sum(abs(hr+rr-tr))"))
def score_transe(spark, d):
    return scored(spark, d, "transe")


@query(all_of("-sum((hr*rr/(sqrt(rr*rr+ri*ri)+1e-12)-hi*ri/(sqrt(rr*rr+ri*ri)+1e-12)-tr)**2+(hr*ri/(sqrt(rr*rr+ri*ri)+1e-12)+hi*rr/(sqrt(rr*rr+ri*ri)+1e-12)-ti)**2)"))
def score_rotate(spark, d):
    return scored(spark, d, "rotate")


@query(all_of("sum(hr*(rr+vr)*tr)"))
def score_tuckert(spark, d):
    return scored(spark, d, "tuckert")


@query(all_of(TC + "+0.1*sum(hi*ti)/((sqrt(sum(hi*hi))+1e-12)*(sqrt(sum(ti*ti))+1e-12))"))
def score_attr_bonus(spark, d):
    """The bonus is one more product: both sides' attributes at unit length join the vectors."""
    g = Vectors(spark, d)
    heads = g.emb.where("id % 20 = 0").select("id", "re", "im", F.transform(unit(F.col("im")), lambda x: 0.1 * x).alias("u"))
    q = g.queries("tcomplex", heads, (1, 6)).join(heads.select(F.col("id").alias("h"), "u"), "h").select("h", "r", "tau", F.concat("q", "u").alias("q"))
    c = g.emb.select("id", F.concat("re", "im", unit(F.col("im"))).alias("c"))
    return blocks.every(q, ["h", "r", "tau"], c).withColumnRenamed("id", "t")


#: One alignment step from zero over seen vectors: rate 0.1, loss weight 0.5, so twice 0.05 of the mean products.
STEP = 0.1


@query(S + f""", seen AS (SELECT id, k, re, im FROM x WHERE id%5<>4), ns AS (SELECT count(*)/32 AS n FROM seen),
w AS (SELECT a.k AS f, b.k, {STEP}::DOUBLE*sum(a.im*b.re)/any_value(n) AS w FROM seen a JOIN seen b ON a.id=b.id CROSS JOIN ns GROUP BY a.k, b.k), bias AS (SELECT k, {STEP}::DOUBLE*sum(re)/any_value(n) AS b FROM seen CROSS JOIN ns GROUP BY k),
pj AS (SELECT a.id AS t, w.k, sum(a.im*w.w)+any_value(bias.b) AS v FROM x a JOIN w ON w.f=a.k JOIN bias ON bias.k=w.k WHERE a.id%5=4 GROUP BY a.id, w.k),
zz AS (SELECT z.h, z.r, z.tau, z.t, round(sum(hr*rr*coalesce(pj.v,tr)),6)+0.0::DOUBLE AS score FROM z LEFT JOIN pj ON pj.t=z.t AND pj.k=z.k GROUP BY ALL)
SELECT h, r, tau, t, score FROM (SELECT *, row_number() OVER (PARTITION BY h, r, tau ORDER BY score DESC, t) AS place FROM zz) WHERE place<=10""")
def score_inductive(spark, d):
    """Vectors with id % 5 = 4 stand for unseen entities: theirs come from features (the second half) by a projection learned from the others."""
    g = Vectors(spark, d)
    seen = g.emb.select("id", F.col("im").alias("f"), F.when(F.col("id") % 5 != 4, F.col("re")).alias("y"))
    learned = projection.moments(seen, "f", "y")
    known = projection.project(seen, "f", "y", projection.aligned(learned, steps=1, rate=0.1, weight=0.5))
    return answers(g, "distmult", known.select("id", F.col("y").alias("c")), 10)


TREES_SQL = """
tree AS (SELECT DISTINCT 'geo' AS hierarchy, 'root' AS parent, 'g:'||r_name AS child FROM region UNION SELECT 'geo', 'g:'||r_name, 'n:'||n_name FROM nation JOIN region ON n_regionkey=r_regionkey
  UNION SELECT 'geo', 'n:'||n_name, 's:'||s_suppkey FROM supplier JOIN nation ON s_nationkey=n_nationkey
  UNION SELECT 'product', 'root', 't:'||p_type FROM part UNION SELECT 'product', 't:'||p_type, 'b:'||p_brand FROM part),
clo AS (SELECT hierarchy, parent AS anc, child AS desc_ FROM tree UNION SELECT c.hierarchy, c.anc, t.child FROM clo c JOIN tree t ON t.hierarchy=c.hierarchy AND t.parent=c.desc_ WHERE c.anc<>t.child)
"""
T = "WITH RECURSIVE " + TREES_SQL


def tree_edges(spark, d):
    read = lambda n: tables.read(spark, d, n)
    pre = lambda p, c: F.concat(F.lit(p), c)
    part = read("part")
    nation = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = [
        read("region").select(F.lit("geo"), F.lit("root"), pre("g:", "r_name")), nation.select(F.lit("geo"), pre("g:", "r_name"), pre("n:", "n_name")),
        read("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit("geo"), pre("n:", "n_name"), pre("s:", F.col("s_suppkey").cast("string"))),
        part.select(F.lit("product"), F.lit("root"), pre("t:", "p_type")), part.select(F.lit("product"), pre("t:", "p_type"), pre("b:", "p_brand")),
    ]
    out = rows[0].toDF("hierarchy", "parent", "child")
    for r in rows[1:]:
        out = out.unionAll(r.toDF("hierarchy", "parent", "child"))
    return out.distinct()


@query(T + " SELECT hierarchy, parent, child FROM tree")
def hierarchy_edges(spark, d):
    return tree_edges(spark, d)


@query(T + ' SELECT hierarchy, anc, desc_ AS "desc" FROM clo')
def closure(spark, d):
    return graph.closure(tree_edges(spark, d))


@query(T + ", " + FACTS_SQL + ", more AS (SELECT parent AS name FROM tree UNION SELECT child FROM tree) SELECT name, id FROM ent UNION ALL SELECT name, (row_number() OVER (ORDER BY name)-1+(SELECT max(id)+1 FROM ent))::INTEGER FROM more WHERE name NOT IN (SELECT name FROM ent)")
def hierarchy_extend(spark, d):
    names = tree_edges(spark, d).select(F.explode(F.array("parent", "child")).alias("name"))
    return kg.extended_ids(kg.entity_ids(facts(spark, d)), names)


#: A point for every tree node: four values of the embedding that its name's rank picks, held in the ball.
POINTS_SQL = TREES_SQL + """,
nn AS (SELECT node, row_number() OVER (ORDER BY node)-1 AS k FROM (SELECT parent AS node FROM tree UNION SELECT child FROM tree)),
pt AS (SELECT node, [embedding[1]::DOUBLE*0.3, embedding[2]::DOUBLE*0.3, embedding[3]::DOUBLE*0.3, embedding[4]::DOUBLE*0.3] AS v FROM nn JOIN embeddings ON vec_id=k%(SELECT count(*) FROM embeddings)),
pn AS (SELECT node, v, sqrt(list_sum(list_transform(v, lambda q: q*q))) AS m FROM pt),
p AS (SELECT node, CASE WHEN m>=1 THEN list_transform(v, lambda q: q/(m+1e-5)*(1-1e-5)) ELSE v END AS x FROM pn),
pm AS (SELECT node, x, sqrt(list_sum(list_transform(x, lambda q: q*q))) AS m FROM p),
shared AS (SELECT DISTINCT a.desc_ AS h, b.desc_ AS t FROM clo a JOIN clo b ON a.hierarchy=b.hierarchy AND a.anc=b.anc AND a.desc_<>b.desc_),
ce AS (SELECT h, t, greatest(0.0::DOUBLE, 1-abs(a.m-b.m)) AS ce FROM shared JOIN pm a ON a.node=h JOIN pm b ON b.node=t)
"""
P = "WITH RECURSIVE " + POINTS_SQL


def points(spark, d):
    edges = tree_edges(spark, d)
    names = edges.select(F.explode(F.array("parent", "child")).alias("name"))
    ranked = kg._numbered(names).select(F.col("name").alias("node"), F.col("id").cast("long").alias("k"))
    v = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") * 0.3)
    read = tables.read(spark, d, "embeddings")
    e = read.select(F.col("vec_id").alias("k"), v.alias("v"))
    return ranked.crossJoin(read.agg(F.count("*").alias("n"))).withColumn("k", F.col("k") % F.col("n")).join(e, "k").select("node", hyp.project(F.col("v")).alias("x"))


@query(P + " SELECT node, round(m,6) AS norm FROM pm")
def poincare_project(spark, d):
    return points(spark, d).select("node", F.round(norm(F.col("x")), 6).alias("norm"))


@query(P + ' SELECT c.hierarchy, c.anc, c.desc_ AS "desc", round(acosh(1+2*list_sum(list_transform(list_zip(a.x,b.x), lambda q: (q[1]-q[2])**2))/((1-a.m*a.m)*(1-b.m*b.m)+1e-12)),6) AS dist FROM clo c JOIN pm a ON a.node=c.anc JOIN pm b ON b.node=c.desc_')
def poincare_distance(spark, d):
    pts = points(spark, d)
    c = graph.closure(tree_edges(spark, d))
    return c.join(pts.toDF("anc", "xa"), "anc").join(pts.toDF("desc", "xd"), "desc").select("hierarchy", "anc", "desc", F.round(hyp.distance(F.col("xa"), F.col("xd")), 6).alias("dist"))


#: The ten largest effects of every node, by norms of six places.
NEAR_SQL = P + """, near AS (SELECT h, t, ce FROM (SELECT h, t, ce, row_number() OVER (PARTITION BY h ORDER BY ce DESC, t) AS place FROM (SELECT h, t, round(greatest(0.0::DOUBLE, 1-abs(round(a.m,6)-round(b.m,6))),6) AS ce FROM shared JOIN pm a ON a.node=h JOIN pm b ON b.node=t)) WHERE place<=10)"""


def near_pairs(spark, d, closed, pts):
    return hyp.nearest_effects(closed, pts, F.lit(True), 10)


@query(NEAR_SQL + " SELECT h, t, ce FROM near")
def causal_effect(spark, d):
    """The ten strongest effects of every node: nearest norms below a shared ancestor, from the places in sorted order."""
    return near_pairs(spark, d, graph.closure(tree_edges(spark, d)), points(spark, d))


@query(P + " SELECT round(avg(ce),6) AS mean, round(stddev_pop(ce),6) AS std, round(max(ce),6) AS max, count(*) AS n, round(avg(ce) FILTER (h LIKE 'n:%')/(avg(ce) FILTER (h LIKE 'b:%')+1e-8),6) AS ratio FROM ce WHERE ce>0")
def ce_group_ratio(spark, d):
    """Figures over all pairs of each tree, from sums over sorted norms; no pair is written."""
    s = hyp.effect_sums(graph.closure(tree_edges(spark, d)), points(spark, d))
    n, mean = F.sum("pairs"), F.sum("effects") / F.sum("pairs")
    of = lambda p: F.sum(F.when(F.col("node").startswith(p), F.col("effects"))) / F.sum(F.when(F.col("node").startswith(p), F.col("pairs")))
    return s.agg(F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(F.sum("squares") / n - mean * mean, F.lit(0.0))), 6).alias("std"), F.round(F.max("most"), 6).alias("max"), n.alias("n"), F.round(of("n:") / (of("b:") + 1e-8), 6).alias("ratio"))


@query(P + " SELECT hierarchy, round(avg(greatest(0.0::DOUBLE, a.m-b.m+0.1)),6) AS loss FROM clo JOIN pm a ON a.node=anc JOIN pm b ON b.node=desc_ GROUP BY ALL")
def tree_norm_loss(spark, d):
    return hyp.ordering_loss(graph.closure(tree_edges(spark, d)), points(spark, d)).withColumn("loss", F.round("loss", 6))


@query(P + ", l AS (SELECT hierarchy, avg(greatest(0.0::DOUBLE, a.m-b.m+0.1)) AS loss FROM clo JOIN pm a ON a.node=anc JOIN pm b ON b.node=desc_ GROUP BY ALL) SELECT round(sum(CASE hierarchy WHEN 'geo' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END*loss),6) AS loss FROM l")
def weighted_tree_loss(spark, d):
    return hyp.weighted_loss(graph.closure(tree_edges(spark, d)), points(spark, d), {"geo": 0.3, "product": 0.2}).withColumn("loss", F.round("loss", 6))


@query(P + """, f AS (SELECT anc, desc_, CASE WHEN a.m>=b.m-0.1 THEN 0.005::DOUBLE ELSE 0.0005::DOUBLE END AS r FROM clo JOIN pm a ON a.node=anc JOIN pm b ON b.node=desc_ WHERE hierarchy='geo'),
g AS (SELECT node, greatest(0.5::DOUBLE, least(2.0::DOUBLE, exp(sum(l)))) AS f FROM (SELECT anc AS node, ln(1-r) AS l FROM f UNION ALL SELECT desc_, ln(1+r) FROM f) GROUP BY node),
n AS (SELECT node, m*coalesce(f,1) AS q FROM pm LEFT JOIN g USING (node))
SELECT node, round(CASE WHEN q>=1 THEN q/(q+1e-5)*(1-1e-5) ELSE q END,6) AS norm FROM n""")
def norm_update(spark, d):
    """Norms after one round of the hyperbolic update over all pairs; the product tree has weight 0 and stays."""
    closed, pts = step(graph.closure(tree_edges(spark, d))), step(points(spark, d))
    after = hyp.scaled(pts, hyp.norm_factors(closed, pts, {"geo": 0.3, "product": 0.0}))
    return after.select("node", F.round(norm(F.col("x")), 6).alias("norm"))


@query()
def norm_fit(spark, d):
    """The weighted ordering loss after each of up to eight rounds."""
    _, losses = hyp.fit_norms(graph.closure(tree_edges(spark, d)), points(spark, d), {"geo": 0.3, "product": 0.2}, 8, rate=0.02)
    return spark.createDataFrame([(i, x) for i, x in enumerate(losses)], "round int, loss double").select("round", F.round("loss", 6).alias("loss"))


@query(P + " SELECT hierarchy, round(avg((a.m<b.m)::INTEGER),6) AS valid, round(avg(b.m-a.m) FILTER (a.m<b.m),6) AS mean_gap, round(min(a.m),6) AS least_norm, round(max(b.m),6) AS most_norm, count(*) AS n FROM clo JOIN pm a ON a.node=anc JOIN pm b ON b.node=desc_ GROUP BY ALL")
def norm_order_validity(spark, d):
    out = hyp.ordering_validity(graph.closure(tree_edges(spark, d)), points(spark, d))
    return out.select("hierarchy", *[F.round(c, 6).alias(c) for c in ("valid", "mean_gap", "least_norm", "most_norm")], "n")


DELTA = [0.1, -0.05, 0.02, 0.03]
CF_SQL = NEAR_SQL + """, nodex AS (SELECT 'g:'||min(r_name) AS s FROM region),
raw AS (SELECT list_transform(list_zip(x,[0.1,-0.05,0.02,0.03]), lambda q: q[1]+q[2]) AS v FROM p, nodex WHERE node=s),
rawm AS (SELECT v, sqrt(list_sum(list_transform(v, lambda q: q*q))) AS m FROM raw),
o AS (SELECT CASE WHEN m>=1 THEN list_transform(v, lambda q: q/(m+1e-5)*(1-1e-5)) ELSE v END AS o FROM rawm),
om AS (SELECT o, list_sum(list_transform(o, lambda q: q*q)) AS oo FROM o),
below AS (SELECT DISTINCT desc_ AS node FROM clo, nodex WHERE anc=s),
mv AS (SELECT pm.node, list_transform(list_zip(x,[0.1,-0.05,0.02,0.03]), lambda q: q[1]+q[2]*0.5*exp(-acosh(1+2*list_sum(list_transform(list_zip(o,x), lambda u: (u[1]-u[2])**2))/((1-oo)*(1-m*m)+1e-12)))) AS v FROM pm JOIN below USING (node), om),
mvm AS (SELECT node, v, sqrt(list_sum(list_transform(v, lambda q: q*q))) AS m FROM mv),
aft AS (SELECT node, least(m, m/(m+1e-5)*(1-1e-5)*(CASE WHEN m>=1 THEN 1 ELSE 1e9 END)) AS m FROM mvm UNION ALL SELECT s, sqrt(oo) FROM om, nodex UNION ALL SELECT node, m FROM pm WHERE node NOT IN (SELECT node FROM below) AND node<>(SELECT s FROM nodex)),
ce0 AS (SELECT near.h, near.t, greatest(0.0::DOUBLE, 1-abs(a.m-b.m)) AS ce FROM near JOIN pm a ON a.node=h JOIN pm b ON b.node=t),
ce1 AS (SELECT h, t, greatest(0.0::DOUBLE, 1-abs(a.m-b.m)) AS ce FROM near JOIN aft a ON a.node=h JOIN aft b ON b.node=t)
SELECT h, t, round(0.05*ce0.ce,6) AS factual, round(0.05*ce1.ce,6) AS counterfactual, round(0.05*ce1.ce-0.05*ce0.ce,6) AS delta FROM ce0 JOIN ce1 USING (h,t)"""


@query(CF_SQL)
def counterfactual(spark, d):
    """Shift the first region and see how the strongest effects of every node change along the tree."""
    closed = step(graph.closure(tree_edges(spark, d)))
    pts = step(points(spark, d))
    node = "g:" + tables.read(spark, d, "region").agg(F.min("r_name")).first()[0]
    pairs = step(near_pairs(spark, d, closed, pts).select("h", "t"))
    out = hyp.counterfactual(pairs.withColumn("score", F.lit(0.0)), pairs, pts, hyp.shifted(pts, closed, node, DELTA), 0.05)
    return out.select("h", "t", *[F.round(c, 6).alias(c) for c in ("factual", "counterfactual", "delta")])


@query(P.replace("WITH RECURSIVE ", "WITH RECURSIVE " + VECTORS_SQL.strip() + ", ") + ", s AS (SELECT a.name AS h, b.name AS t, sum(a.re*c.re*b.re) AS s FROM xe a JOIN xe b ON a.k=b.k AND a.id<>b.id JOIN xr c ON c.k=a.k AND c.name='1-URGENT' WHERE a.name LIKE 'b:%' AND b.name LIKE 'b:%' GROUP BY ALL) SELECT s.h, s.t, round(s+0.05*coalesce(ce,0),6)+0.0::DOUBLE AS score FROM s LEFT JOIN ce ON ce.h=s.h AND ce.t=s.t")
def score_causal(spark, d):
    """A stated list of pairs, those of brands: a trilinear score plus the effect along the product tree."""
    g = Vectors(spark, d)
    brands = g.e.where(F.col("name").startswith("b:"))
    rel = g.r.where("name = '1-URGENT'").select(F.col("re").alias("r_re"))
    a, b = brands.select(F.col("name").alias("h"), F.col("re").alias("h_re")), brands.select(F.col("name").alias("t"), F.col("re").alias("t_re"))
    rows = step(a.crossJoin(b).where("h <> t").crossJoin(rel).select("h", "t", scoring.distmult("h_re", "r_re", "t_re").alias("s")))
    ce = hyp.causal_effect(hyp.sharing(rows.select("h", "t"), graph.closure(tree_edges(spark, d))), points(spark, d))
    return rows.join(ce, ["h", "t"], "left").select("h", "t", (F.round(scoring.causal_bonus(F.col("s"), F.col("ce")), 6) + 0.0).alias("score"))


#: Rows of the last year, which are test rows and known rows alike, and TComplEx scores of all entities as tails.
RANK_SQL = KNOWN_SQL + """,
sc AS (SELECT h, r, tau, t AS cand, round(""" + TC + """,6)+0.0::DOUBLE AS score FROM z WHERE tau=6 GROUP BY ALL),
te AS (SELECT * FROM quads WHERE tau=6), kn AS (SELECT DISTINCT h, r, tau, t FROM te),
rk AS (SELECT te.h, te.r, te.tau, te.t, (1+count(*) FILTER (s.score>own.score AND s.cand<>te.t AND kn.t IS NULL))::BIGINT AS rank FROM te JOIN sc own ON own.h=te.h AND own.r=te.r AND own.tau=te.tau AND own.cand=te.t JOIN sc s ON s.h=te.h AND s.r=te.r AND s.tau=te.tau LEFT JOIN kn ON kn.h=te.h AND kn.r=te.r AND kn.tau=te.tau AND kn.t=s.cand GROUP BY ALL)
"""
R = "WITH " + RANK_SQL
METRICS = "round(coalesce(avg(1.0::DOUBLE/rank),0),6) AS mrr, round(coalesce(avg((rank<=1)::INTEGER),0),6) AS hits1, round(coalesce(avg((rank<=3)::INTEGER),0),6) AS hits3, round(coalesce(avg((rank<=10)::INTEGER),0),6) AS hits10, round(coalesce(avg(rank),0),6) AS mean_rank"


def ranked(g):
    last = step(g.quads.where("tau = 6"))
    return kg.filtered_ranks(last, g.queries("tcomplex", g.nations, (6,)), tails("tcomplex", g.e), last)


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(R + " SELECT h, r, tau, t, rank FROM rk")
def filtered_ranks(spark, d):
    return ranked(Vectors(spark, d))


@query(R + f" SELECT {METRICS} FROM rk")
def link_prediction_metrics(spark, d):
    return _rounded(kg.rank_metrics(ranked(Vectors(spark, d))))


@query(R + f" SELECT CASE WHEN name LIKE 'b:%' THEN 'brand' ELSE 'region' END AS type, {METRICS} FROM rk JOIN ent ON ent.id=rk.t GROUP BY ALL")
def metrics_by_type(spark, d):
    g = Vectors(spark, d)
    kind = F.when(F.col("name").startswith("b:"), "brand").otherwise("region")
    return _rounded(kg.rank_metrics(g.names(ranked(g), t="name").withColumn("type", kind), ["type"]))


SIGMOID = "round(1/(1+exp(-greatest(least(s,50.0::DOUBLE),-50.0::DOUBLE))),6)"
#: Priorities that count as threats; those that the facts lack are left out.
THREATS = ["1-URGENT", "2-HIGH", "0-UNHEARD"]


def pair_scores(g, times=None, relations=None):
    """Scores of every nation with every brand: a stated list of pairs."""
    brands = tails("tcomplex", g.e.where(F.col("name").startswith("b:"))).withColumnRenamed("id", "t")
    return g.queries("tcomplex", g.nations, times, relations).crossJoin(brands).select("h", "r", "tau", "t", (F.round(dot(F.col("q"), F.col("c")), 6) + 0.0).alias("score"))


@query("WITH " + KNOWN_SQL + ", s AS (SELECT hn AS h, tn AS t, rn AS relation, round(" + TC + ",6) AS s FROM z WHERE tau=6 AND rn IN ('1-URGENT','2-HIGH','0-UNHEARD') AND tn LIKE 'b:%' GROUP BY ALL) SELECT h, t, relation, " + SIGMOID + " AS prob FROM s")
def threat_relations(spark, d):
    """The probability of each threat that the facts know, for every nation and brand in the last year, with names."""
    g = Vectors(spark, d)
    present = kg.relations_present(g.quads, g.relations, THREATS)
    s = kg.threat_probabilities(pair_scores(g, (6,), g.r.join(present.select("id"), "id", "left_semi")))
    named = kg.decode(g.names(s, h="hn", t="tn"), g.relations, {"r": "relation"})
    return named.select(F.col("hn").alias("h"), F.col("tn").alias("t"), "relation", F.round("prob", 6).alias("prob"))


@query(R + ", s AS (SELECT h, hn, t, tn, round(" + TC + ",6)+0.0::DOUBLE AS s FROM z WHERE rn='2-HIGH' AND tau=6 AND tn LIKE 'b:%' GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY s DESC, h) AS k FROM s) SELECT tn AS t, hn AS h, s AS score, EXISTS (SELECT 1 FROM quads q JOIN rel ON rel.id=q.r AND rel.name='2-HIGH' WHERE q.h=o.h AND q.t=o.t AND q.tau=6) AS deployed FROM o WHERE k<=5")
def recommend_topk(spark, d):
    """The five best nations for every brand by name, and whether the fact holds already. Brands are the queries, nations the candidates."""
    g = Vectors(spark, d)
    high = g.r.where("name = '2-HIGH'")
    # the score is linear in the tail, so heads with the relation folded in are what a brand's vector meets
    heads = g.queries("tcomplex", g.nations, (6,), high).select(F.col("h").alias("id"), F.col("q").alias("c"))
    brands = tails("tcomplex", g.e.where(F.col("name").startswith("b:"))).select(F.col("id").alias("t"), F.col("c").alias("q"))
    found = blocks.best(brands, ["t"], heads, 5).withColumnRenamed("id", "h")
    on = g.quads.where("tau = 6").join(high.select(F.col("id").alias("r")), "r", "left_semi").select("t", "h").distinct().withColumn("deployed", F.lit(True))
    return g.names(kg.recommend(found, on, 5, by=["t"]), h="hn", t="tn").select(F.col("tn").alias("t"), F.col("hn").alias("h"), "score", "deployed")


@query(R + ", s AS (SELECT h, hn, tau, t, tn, round(" + TC + ",6)+0.0::DOUBLE AS s FROM z WHERE rn='1-URGENT' AND tau IN (1,6) AND tn LIKE 'b:%' GROUP BY ALL), m AS (SELECT h, hn, t, tn, round(1/(1+exp(-greatest(least(avg(s),50.0::DOUBLE),-50.0::DOUBLE))),6) AS prob FROM s WHERE NOT EXISTS (SELECT 1 FROM quads q JOIN rel ON rel.id=q.r AND rel.name='1-URGENT' WHERE q.h=s.h AND q.t=s.t AND q.tau<=1) GROUP BY ALL) SELECT hn AS h, tn AS cand, prob FROM (SELECT * FROM m WHERE prob>0.3 ORDER BY prob DESC, h, t LIMIT 20)")
def novel_threats(spark, d):
    g = Vectors(spark, d)
    urgent = g.r.where("name = '1-URGENT'")
    s = pair_scores(g, (1, 6), urgent).withColumnRenamed("t", "cand")
    known = g.quads.where("tau <= 1").join(urgent.select(F.col("id").alias("r")), "r", "left_semi")
    return g.names(kg.novel_links(s, known, 0.3, 20), h="hn", cand="cn").select(F.col("hn").alias("h"), F.col("cn").alias("cand"), "prob")


@query("WITH " + KNOWN_SQL + ", s AS (SELECT h, r, tau, t, round(" + TC + ",6) AS s FROM z WHERE tn LIKE 'b:%' GROUP BY ALL) SELECT h, r, t, tau, " + SIGMOID + " AS prob FROM s")
def threat_evolution(spark, d):
    return kg.threat_probabilities(pair_scores(Vectors(spark, d))).select("h", "r", "t", "tau", F.round("prob", 6).alias("prob"))


@query(R + " SELECT round(avg(greatest(0.0::DOUBLE, 1+n.score-p.score)),6) AS loss FROM kn JOIN sc p ON p.h=kn.h AND p.r=kn.r AND p.tau=kn.tau AND p.cand=kn.t JOIN sc n ON n.h=kn.h AND n.r=kn.r AND n.tau=kn.tau AND n.cand<>kn.t")
def margin_loss(spark, d):
    """The hinge of every fact of the last year against every other entity."""
    g = Vectors(spark, d)
    return _rounded(kg.all_margin_loss(step(g.quads.where("tau = 6")), g.queries("tcomplex", g.nations, (6,)), tails("tcomplex", g.e)))


@query("WITH c AS (SELECT c_custkey, [(c_mktsegment='BUILDING')::INTEGER::DOUBLE, (c_mktsegment='AUTOMOBILE')::INTEGER::DOUBLE, least(greatest(c_acctbal,0)/10000,1), (c_nationkey%3=0)::INTEGER::DOUBLE] AS v FROM customer), m AS (SELECT *, sqrt(list_sum(list_transform(v, lambda q: q*q))) AS n FROM c) SELECT c_custkey, round(v[1]/k,6) AS f1, round(v[2]/k,6) AS f2, round(v[3]/k,6) AS f3, round(v[4]/k,6) AS f4 FROM (SELECT *, CASE WHEN n<1e-8 THEN 1 ELSE n END AS k FROM m)")
def entity_features(spark, d):
    c = tables.read(spark, d, "customer")
    on = lambda x: x.cast("int").cast("double")
    v = normalised(F.array(on(F.col("c_mktsegment") == "BUILDING"), on(F.col("c_mktsegment") == "AUTOMOBILE"), F.least(F.greatest("c_acctbal", F.lit(0.0)) / 10000, F.lit(1.0)), on(F.col("c_nationkey") % 3 == 0)))
    return c.select("c_custkey", v.alias("f")).select("c_custkey", *[F.round(F.col("f")[i], 6).alias(f"f{i + 1}") for i in range(4)])


@query("WITH x AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda q: q::DOUBLE*q::DOUBLE)))+1e-12 AS n FROM embeddings), c AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(list_zip(a.embedding,b.embedding), lambda q: q[1]::DOUBLE*q[2]::DOUBLE))/(a.n*b.n),6)+0.0::DOUBLE AS cos FROM x a JOIN x b ON a.vec_id%20=0) SELECT a, b, cos FROM c")
def attribute_cosine(spark, d):
    """A stated query set, the vectors whose id is divisible by 20, against all vectors, itself included. Each is normalised once."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = tables.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), unit(v).alias("c"))
    return blocks.every(e.where("id % 20 = 0").toDF("a", "q"), ["a"], e).select("a", F.col("id").alias("b"), F.col("score").alias("cos"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def slots(size):
    """Slots by kind of fact: facts by priority, and the region; sixteen places also tell how many facts are still open, early, late, and regions from nations."""
    r, other, head = F.col("r"), F.col("other"), F.col("side") == "h"
    out = [(r == p, 25.0) for p in PRIORITIES] + [((r == "in_region") & head & (other == f"g:{g}"), 1.0) for g in REGIONS]
    if size == 16:
        out += [(F.col("te").isNull() & F.col("tb").isNotNull(), 100.0), (F.col("tb") == 0, 100.0), (F.col("te") <= 4, 100.0), ((r == "in_region") & ~head, 5.0), (head & (r != "in_region"), 100.0)]
    return out


def _features_sql(size):
    flag = lambda c: f"least(count(*) FILTER ({c[0]})/{c[1]}::DOUBLE,1)"
    parts = [(f"r='{p}'", 25.0) for p in PRIORITIES] + [(f"r='in_region' AND side='h' AND other='g:{g}'", 1.0) for g in REGIONS]
    if size == 16:
        parts += [("te IS NULL AND tb IS NOT NULL", 100.0), ("tb=0", 100.0), ("te<=4", 100.0), ("r='in_region' AND side='t'", 5.0), ("side='h' AND r<>'in_region'", 100.0)]
    pad = ", 0.0::DOUBLE" * (size - len(parts) - 1)
    return K + f""", sd AS (SELECT 'h' AS side, h AS name, t AS other, r, tb, te FROM facts UNION ALL SELECT 't', t, h, r, tb, te FROM facts),
v AS (SELECT name, [{", ".join(flag(p) for p in parts)}] AS v FROM sd GROUP BY name), w AS (SELECT name, list_concat(v, [{pad[2:] + ", " if pad else ""}CASE WHEN list_sum(v)>0 THEN 0 ELSE 0.01 END::DOUBLE]) AS v FROM v)
SELECT name, {", ".join(f"round(v[{i + 1}]/sqrt(list_sum(list_transform(v, lambda q: q*q))),6) AS f{i + 1}" for i in range(size))} FROM w"""


def _features(spark, d, size):
    f = step(facts(spark, d))
    made = features.fact_features(kg.entity_ids(f), f, slots(size), size)
    return made.select("name", *[F.round(F.col("f")[i], 6).alias(f"f{i + 1}") for i in range(size)])


@query(_features_sql(12))
def fact_features_12(spark, d):
    """Every entity's twelve slots, out of the facts."""
    return _features(spark, d, 12)


@query(_features_sql(16))
def fact_features_16(spark, d):
    return _features(spark, d, 16)


@query(K + """, sd AS (SELECT h AS name, r FROM facts UNION ALL SELECT t, r FROM facts), f AS (SELECT name, [1.0::DOUBLE""" + "".join(f", count(*) FILTER (r='{p}')::DOUBLE" for p in PRIORITIES) + """] AS f FROM sd GROUP BY name),
s AS (SELECT f.f, list_transform(e.embedding[1:4], lambda q: q::DOUBLE) AS y FROM f JOIN ent USING (name) JOIN embeddings e ON e.vec_id=ent.id%(SELECT count(*) FROM embeddings) WHERE ent.id%5<>4)
SELECT i::INTEGER AS i, j::INTEGER AS j, round(sum(f[i+1]*(CASE WHEN j<6 THEN f[j+1] ELSE y[j-5] END)),4) AS value FROM s, range(0,6) a(i), range(0,10) b(j) GROUP BY ALL""")
def projection_moments(spark, d):
    """The sums of which the normal equations consist: facts by priority as features, four embedding values as targets, over entities that are not held out."""
    f = step(facts(spark, d))
    ids = step(kg.entity_ids(f))
    both = f.select(F.explode(F.array("h", "t")).alias("name"), "r").groupBy("name").agg(F.array(*[F.count_if(F.col("r") == p).cast("double") for p in PRIORITIES]).alias("f"))
    e = tables.read(spark, d, "embeddings").select(F.col("vec_id").alias("_v"), F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("y"))
    n = e.count()
    rows = both.join(ids, "name").where("id % 5 <> 4").withColumn("_v", F.col("id") % n).join(e, "_v")
    return projection.moment_rows(rows, "f", "y").withColumn("value", F.round("value", 4))


def trained(spark, d, rows, epochs, features_by_size=16):
    """Configurations trained together on the first five years, with features, trees and norms of all entities; ranked on the last year."""
    g = Graph(spark, d)
    made = features.fact_features(g.entities, g.facts, slots(features_by_size), features_by_size)
    edges = tree_edges(spark, d)
    closed = step(graph.closure(edges))
    top = closed.join(closed.select("hierarchy", F.col("desc").alias("anc")).distinct(), ["hierarchy", "anc"], "left_anti")
    trees = top.groupBy(F.col("desc").alias("name")).agg((F.xxhash64(F.min(F.concat("hierarchy", "anc"))) % 1_000_000).alias("tree"))
    norms = points(spark, d).select(F.col("node").alias("name"), norm(F.col("x")).alias("norm"))
    entities = g.entities.join(made, "name").join(trees, "name", "left").join(norms, "name", "left").select("id", "f", F.coalesce("tree", -F.col("id") - 2_000_000).alias("tree"), F.coalesce("norm", F.lit(0.0)).alias("norm"), (F.col("id") % 5 != 4).alias("seen"))
    entities = step(entities)
    quads = step(g.quads)
    configs = spark.createDataFrame(rows, descent.CONFIG)
    params, history = descent.train(quads.where("tau <= 4"), configs, entities, g.relations, YEARS, epochs)
    test = step(quads.where("tau = 6"))
    out = None
    for name, model, *_ in rows:
        q, c, how = descent.vectors(params, name, model, entities, test.select("h", "r", "tau").distinct())
        got = kg.rank_metrics(kg.filtered_ranks(test, q, c, test, how)).select(F.lit(name).alias("config"), F.lit(model).alias("model"), F.lit(history[0][name]).alias("first_loss"), F.lit(history[-1][name]).alias("last_loss"), "*")
        out = got if out is None else out.unionByName(got)
    return _rounded(out)


@query()
def train_models(spark, d):
    """Four models that differ by what they know besides facts: nothing, features in the score, features for unseen entities, effects along trees."""
    return trained(spark, d, [(m, m, 16, 4, 1.0) for m in ("tcomplex", "eai_tcomplex", "inductive", "chkg")], 3)


@query()
def ablation_grid(spark, d):
    """Sizes, negatives, margins, and without time."""
    rows = [("dim8", "tcomplex", 8, 4, 1.0), ("dim16", "tcomplex", 16, 4, 1.0), ("neg2", "tcomplex", 16, 2, 1.0), ("margin2", "tcomplex", 16, 4, 2.0), ("static", "complex", 16, 4, 1.0), ("translation", "transe", 16, 4, 1.0)]
    return trained(spark, d, rows, 2)
