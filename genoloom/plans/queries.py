"""One query for each operator, over the driver's tables, with its SQL for DuckDB beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.operators import cluster, groups, matrix, merge, pairs, variants
from genoloom.operators import reads as R
from genoloom.operators.folded import Folded, unfolded
from genoloom.operators.points import Points
from genoloom.plans import adapter as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: A sequencing error at which the binomial filter bites on these tables.
ERROR = 0.3
CUTOFF = 0.07

PRELUDE = """
WITH RECURSIVE cellsd AS (SELECT l_suppkey, row_number() OVER (ORDER BY l_suppkey) - 1 AS cell FROM (SELECT DISTINCT l_suppkey FROM lineitem)),
sitesd AS (SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) AS site FROM part),
reads AS (
  SELECT site, cell, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS allele, l_linestatus = 'O' AS forward, l_linenumber > 4 AS dup, l_orderkey % 64 AS umi,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus
  FROM lineitem JOIN sitesd ON l_partkey = p_partkey JOIN cellsd USING (l_suppkey)),
obs AS (
  SELECT site, cell, allele, count(*) FILTER (forward AND NOT dup) AS f_umi, count(*) FILTER (NOT forward AND NOT dup) AS r_umi,
         count(*) FILTER (forward) AS f_reads, count(*) FILTER (NOT forward) AS r_reads FROM reads GROUP BY ALL),
arr AS (
  SELECT site, cell, coalesce(sum(f_umi + r_umi) FILTER (allele = 0), 0)::DOUBLE AS n0, coalesce(sum(f_umi + r_umi) FILTER (allele = 1), 0)::DOUBLE AS n1,
         coalesce(sum(f_umi + r_umi) FILTER (allele = 2), 0)::DOUBLE AS n2, n0 + n1 + n2 AS t FROM obs GROUP BY ALL),
pairs AS (
  SELECT a.cell AS s1, b.cell AS s2, a.site, a.n0 AS x0, a.n1 AS x1, a.n2 AS x2, a.t AS tx, b.n0 AS y0, b.n1 AS y1, b.n2 AS y2, b.t AS ty
  FROM arr a JOIN arr b ON a.site = b.site AND a.cell < b.cell WHERE a.t > 5 AND b.t > 5),
dist AS (
  SELECT s1, s2, count(*) AS positions, round(sum(pow(abs(x0 / tx - y0 / ty) / sqrt(2), 4) + pow(abs(x1 / tx - y1 / ty) / sqrt(2), 4) + pow(abs(x2 / tx - y2 / ty) / sqrt(2), 4)), 6) AS d
  FROM pairs GROUP BY s1, s2),
sym AS (SELECT s1, s2, d FROM dist UNION ALL SELECT s2, s1, d FROM dist),
grps AS (SELECT cell, (l_suppkey % 3)::INT AS grp FROM cellsd),
gobs AS (SELECT site, grp, allele, sum(f_umi)::BIGINT AS f_umi, sum(r_umi)::BIGINT AS r_umi, sum(f_reads)::BIGINT AS f_reads, sum(r_reads)::BIGINT AS r_reads FROM obs JOIN grps USING (cell) GROUP BY ALL),
gcn AS (SELECT site, grp, count(DISTINCT cell) AS cn FROM obs JOIN grps USING (cell) GROUP BY ALL),
gd AS (
  SELECT g.grp, coalesce(sum(d), 0) / any_value(n) AS d FROM (SELECT grp, count(*) AS n FROM grps GROUP BY 1) g
  LEFT JOIN (SELECT a.grp, d FROM sym JOIN grps a ON s1 = a.cell JOIN grps b ON s2 = b.cell WHERE a.grp = b.grp) x USING (grp) GROUP BY 1)
"""


def query(sql: str | None = None, prelude: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (PRELUDE if prelude else "") + sql
        return f

    return add


def _dist(spark: SparkSession, sf_dir: str, name: str = "pow4", known: DataFrame | None = None, points: int | None = None) -> Folded | DataFrame | Points:
    """s1, s2, positions, d, by classes of equal cells where that saves work; or the cells' points, if there are more classes than ``points``."""
    return A.distances(spark, sf_dir, name, known, points)


def _distance(spark: SparkSession, sf_dir: str, name: str = "pow4") -> DataFrame:
    """s1, s2, positions, d of all pairs of cells."""
    return unfolded(_dist(spark, sf_dir, name))


def _pow(p: int, weight: str = "") -> str:
    return " + ".join(f"pow(abs(x{k} / tx - y{k} / ty) / sqrt(2), {p}){weight.format(k=k)}" for k in range(3))


_CHI2 = " + ".join(
    f"CASE WHEN x{k} + y{k} > 0 THEN (x{k} - tx * ((x{k} + y{k}) / (tx + ty))) ** 2 / (tx * ((x{k} + y{k}) / (tx + ty))) + (y{k} - tx * ((x{k} + y{k}) / (tx + ty))) ** 2 / (tx * ((x{k} + y{k}) / (tx + ty))) ELSE 0 END" for k in range(3)
)


@query("SELECT s1, s2, positions, d FROM dist")
def pair_distance_pow4(spark, sf_dir):
    return _distance(spark, sf_dir).select("s1", "s2", "positions", "d")


@query(f"SELECT s1, s2, round(sum({_pow(2, ' * (x{k} / tx + y{k} / ty) / 2')}), 6) AS d FROM pairs GROUP BY 1, 2")
def pair_distance_depthpow2(spark, sf_dir):
    return _distance(spark, sf_dir, "depthpow2").select("s1", "s2", "d")


@query(f"SELECT s1, s2, round(sum({_CHI2}), 6) AS d FROM pairs GROUP BY 1, 2")
def pair_distance_chi2(spark, sf_dir):
    return _distance(spark, sf_dir, "chi2").select("s1", "s2", "d")


_SQUARES = ", ".join(f"pairs.{c}{k} ** 2 AS {c}{k}" for c in "xy" for k in range(3)) + "".join(f", pairs.{c}0 ** 2 + pairs.{c}1 ** 2 + pairs.{c}2 ** 2 AS t{c}" for c in "xy")


@query(f", sq AS (SELECT s1, s2, {_SQUARES} FROM pairs) SELECT s1, s2, round(sum(sqrt({_CHI2})), 6) AS d FROM sq GROUP BY 1, 2")
def pair_distance_chi2pow(spark, sf_dir):
    return _distance(spark, sf_dir, "chi2pow2-0.5").select("s1", "s2", "d")


@query("SELECT s1, s2, positions FROM dist")
def pair_positions(spark, sf_dir):
    return _distance(spark, sf_dir).select("s1", "s2", "positions")


@query(
    "SELECT s1, s2, site, k AS allele, round(x / tx, 9) AS f1, round(y / ty, 9) AS f2, round(abs(x / tx - y / ty) / sqrt(2), 9) AS distance FROM ("
    + " UNION ALL ".join(f"SELECT s1, s2, site, {k} AS k, x{k} AS x, y{k} AS y, tx, ty FROM pairs" for k in range(3))
    + ")"
)
def pair_scatter(spark, sf_dir):
    rows = pairs.scatter(A.observations(spark, sf_dir))
    return rows.select("s1", "s2", "site", "allele", *(F.round(c, 9).alias(c) for c in ("f1", "f2", "distance")))


@query("SELECT s1, s2, round(d / positions, 9) AS d FROM dist")
def dist_normalised(spark, sf_dir):
    return pairs.normalised(_distance(spark, sf_dir)).select("s1", "s2", F.round("d", 9).alias("d"))


@query("SELECT coalesce(cell::VARCHAR, 'No-Barcode') AS barcode, count(*) FILTER (NOT dup) AS umi, count(*) AS read FROM reads GROUP BY 1")
def reads_per_barcode(spark, sf_dir):
    return R.reads_per_barcode(A.reads(spark, sf_dir), "cell")


@query("SELECT n AS value, count(*) AS count FROM (SELECT count(*) FILTER (NOT dup) AS n FROM reads GROUP BY cell) GROUP BY 1")
def reads_histogram(spark, sf_dir):
    return R.histogram(R.reads_per_barcode(A.reads(spark, sf_dir), "cell"), "umi")


@query("SELECT n AS value, count(*) AS count FROM (SELECT count(*) AS n FROM reads GROUP BY cell) GROUP BY 1")
def reads_histogram_dups(spark, sf_dir):
    return R.histogram(R.reads_per_barcode(A.reads(spark, sf_dir), "cell"), "read")


@query("SELECT * FROM obs")
def pileup(spark, sf_dir):
    return A.observations(spark, sf_dir)


@query(
    ", u AS (SELECT *, row_number() OVER (PARTITION BY site, umi ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) = 1 AS new FROM reads)"
    " SELECT site, cell, allele, count(*) FILTER (forward AND new) AS f_umi, count(*) FILTER (NOT forward AND new) AS r_umi, count(*) FILTER (forward) AS f_reads, count(*) FILTER (NOT forward) AS r_reads FROM u GROUP BY ALL"
)
def pileup_umi(spark, sf_dir):
    return R.pileup_umi(A.reads(spark, sf_dir), A.ORDER)


@query(
    "SELECT site, sum(f_umi + r_umi)::BIGINT AS total, sum(f_reads + r_reads)::BIGINT AS read_total, sum(CASE WHEN allele = 0 THEN f_umi + r_umi ELSE 0 END)::BIGINT AS ref_depth,"
    " sum(CASE WHEN allele > 0 THEN f_umi + r_umi ELSE 0 END)::BIGINT AS alt_depth, round(alt_depth::DOUBLE / nullif(total, 0), 9) AS alt_ratio FROM obs GROUP BY site"
)
def variant_depths(spark, sf_dir):
    return variants.site_depths(A.observations(spark, sf_dir)).withColumn("alt_ratio", F.round("alt_ratio", 9))


@query("SELECT site, allele, sum(f_umi + r_umi)::BIGINT AS depth, sum(f_reads + r_reads)::BIGINT AS read_depth FROM obs GROUP BY ALL")
def allele_depths(spark, sf_dir):
    return variants.allele_depths(A.observations(spark, sf_dir))


_P = """, pn AS (SELECT *, f_reads + r_reads AS k, sum(f_reads + r_reads) OVER (PARTITION BY site, cell) AS n FROM obs),
pv AS (
  SELECT pn.* EXCLUDE (k, n), CASE WHEN n < 2 THEN 1.0 ELSE greatest(0.0, 1 - (
    SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.30000001192092896) + (n - i) * ln(1 - 0.30000001192092896::DOUBLE))) FROM (SELECT unnest(range(0, k + 1)) AS i))) END AS p_value FROM pn)
"""


@query(_P + "SELECT site, cell, allele, round(p_value, 6) AS p_value FROM pv")
def allele_pvalue(spark, sf_dir):
    return variants.p_values(A.observations(spark, sf_dir), ERROR).select("site", "cell", "allele", F.round("p_value", 6).alias("p_value"))


_CLEAN = _P + """, z AS (
  SELECT site, cell, allele, f_umi * keep AS f_umi, r_umi * keep AS r_umi, f_reads * keep AS f_reads, r_reads * keep AS r_reads FROM (SELECT *, (p_value <= 0.05000000074505806)::BIGINT AS keep FROM pv)),
c AS (
  SELECT * FROM z QUALIFY (allele = 0 OR sum(f_umi + r_umi) OVER (PARTITION BY site, allele) > 0) AND sum(f_umi + r_umi) OVER (PARTITION BY site, cell) > 0),
cl AS (SELECT * REPLACE ((CASE WHEN allele = 0 THEN 0 ELSE dense_rank() OVER (PARTITION BY site, allele > 0 ORDER BY allele) END)::INT AS allele) FROM c)
"""


@query(_CLEAN + "SELECT * FROM cl")
def variants_cleaned(spark, sf_dir):
    return variants.cleaned(variants.zero_improbable(A.observations(spark, sf_dir), ERROR))


@query(
    _CLEAN
    + "SELECT cl.* FROM cl JOIN (SELECT site FROM cl GROUP BY 1 HAVING sum(CASE WHEN allele > 0 THEN f_umi + r_umi ELSE 0 END) >= 100 AND sum(f_umi + r_umi) >= 5 AND max(CASE WHEN allele > 0 THEN f_umi + r_umi ELSE 0 END) >= 2) USING (site)"
)
def variants_filtered(spark, sf_dir):
    clean = variants.cleaned(variants.zero_improbable(A.observations(spark, sf_dir), ERROR))
    return variants.filtered(clean, variants.Cutoffs(min_alternative_depth=100))


@query("SELECT obs.* FROM obs JOIN (SELECT site FROM obs GROUP BY 1 HAVING sum(CASE WHEN allele > 0 THEN f_umi + r_umi ELSE 0 END)::DOUBLE / nullif(sum(f_umi + r_umi), 0) >= 0.49) USING (site)")
def variants_alt_ratio(spark, sf_dir):
    return variants.alt_ratio_at_least(A.observations(spark, sf_dir), 0.49)


@query("SELECT site, cell, allele, f_umi * k AS f_umi, r_umi * k AS r_umi, f_reads * k AS f_reads, r_reads * k AS r_reads FROM (SELECT *, (f_umi + r_umi >= 6)::BIGINT AS k FROM obs)")
def variants_shallow(spark, sf_dir):
    return variants.zero_shallow(A.observations(spark, sf_dir), 6)


@query(f"SELECT cell, (SELECT count(*) FROM cellsd) - n_wrong AS n_overlap, n_wrong FROM (SELECT cell, count(d) AS n_wrong FROM cellsd LEFT JOIN (SELECT * FROM sym WHERE d > {CUTOFF}) ON s1 = cell GROUP BY 1)")
def dist_overlap(spark, sf_dir):
    cells = A.listed(spark, sf_dir)
    return matrix.overlap(_dist(spark, sf_dir, known=cells), cells, CUTOFF)


@query(f"SELECT s1, s2 FROM sym WHERE d > {CUTOFF}")
def dist_wrong(spark, sf_dir):
    return matrix.wrong(_dist(spark, sf_dir), CUTOFF)


@query("SELECT s1, s2, d FROM dist WHERE s1 % 3 = 0 AND s2 % 3 = 0")
def dist_submatrix(spark, sf_dir):
    return matrix.submatrix(_dist(spark, sf_dir), A.cells(spark, sf_dir).filter("cell % 3 = 0"))


@query("SELECT d AS value, count(*) AS count FROM dist GROUP BY 1")
def dist_histogram(spark, sf_dir):
    return matrix.histogram(_dist(spark, sf_dir))


@query("SELECT floor(d * 1000 + 0.5) / 1000 AS value, count(*) AS count FROM dist GROUP BY 1")
def dist_histogram_binned(spark, sf_dir):
    return matrix.binned(matrix.histogram(_dist(spark, sf_dir)))


@query("SELECT a.grp AS g1, b.grp AS g2, d AS value, count(*) AS count FROM sym JOIN grps a ON s1 = a.cell JOIN grps b ON s2 = b.cell WHERE a.grp <= b.grp GROUP BY ALL")
def subgroup_histogram(spark, sf_dir):
    return matrix.subgroup_histogram(_dist(spark, sf_dir), A.groups(spark, sf_dir))


@query("SELECT grp, round(d, 5) AS d FROM gd")
def group_distance(spark, sf_dir):
    return matrix.group_distance(_dist(spark, sf_dir), A.groups(spark, sf_dir)).select("grp", F.round("d", 5).alias("d"))


@query("SELECT s1 AS cell, grp, round(sum(d), 6) AS sum, any_value(n) AS n FROM sym JOIN grps ON s2 = cell JOIN (SELECT grp, count(*) AS n FROM grps GROUP BY 1) USING (grp) GROUP BY 1, 2")
def cell_group_distance(spark, sf_dir):
    cells = A.listed(spark, sf_dir)
    return matrix.cell_group_distance(_dist(spark, sf_dir, known=cells), A.groups(spark, sf_dir, cells)).withColumn("sum", F.round("sum", 6))


@query(f", few AS (SELECT * FROM sym WHERE d > {CUTOFF}) SELECT cell FROM cellsd LEFT JOIN (SELECT s1, count(*) AS k FROM few GROUP BY 1) ON s1 = cell WHERE coalesce(k, 0) < 0.25 * (SELECT count(*) FROM cellsd)")
def sparse_cells(spark, sf_dir):
    cells = A.listed(spark, sf_dir)
    return matrix.sparse_cells(_dist(spark, sf_dir, known=cells).filter(F.col("d") > CUTOFF), cells)


@query("SELECT * FROM gobs")
def group_calls(spark, sf_dir):
    return groups.group_calls(A.observations(spark, sf_dir), A.groups(spark, sf_dir))[0]


_PROB = "(1 - ({f} * 2 - {n}) ** 2)"


def _phred_sql(f: str, n: int) -> str:
    p = _PROB.format(f=f, n=n)
    return f"CASE WHEN {f} IS NULL THEN 0 WHEN {p} <= 0 THEN 2147483647 ELSE trunc(-10 * ln({p}))::INT END"


_GENO = (
    ", ga AS (SELECT site, grp, " + ", ".join(f"coalesce(sum(f_umi + r_umi) FILTER (allele = {k}), 0)::BIGINT AS a{k}" for k in range(3)) + " FROM gobs GROUP BY 1, 2),"
    " gf AS (SELECT *, " + ", ".join(f"a{k}::DOUBLE / nullif(a0 + a1 + a2, 0) AS f{k}" for k in range(3)) + " FROM ga),"
    " gp AS (SELECT *, " + ", ".join(f"{_phred_sql(f'f{k}', n)} AS p{k}{n}" for k in range(3) for n in range(3)) + " FROM gf),"
    " opt AS (" + " UNION ALL ".join(f"SELECT site, grp, {k} AS i, {n} AS n, p{k}{n} AS pl FROM gp WHERE a{k} >= 1" for k in range(3) for n in (1, 2)) + "),"
    " one AS (SELECT * FROM opt QUALIFY row_number() OVER (PARTITION BY site, grp ORDER BY pl, i, n) = 1),"
    " two AS (SELECT opt.* FROM opt JOIN one ON opt.site = one.site AND opt.grp = one.grp AND opt.i <> one.i WHERE one.n = 1 AND opt.n = 1 QUALIFY row_number() OVER (PARTITION BY opt.site, opt.grp ORDER BY opt.pl, opt.i) = 1),"
    " gt AS (SELECT gp.*, CASE WHEN one.i IS NULL THEN './.' WHEN one.n = 2 THEN one.i || '/' || one.i WHEN two.i IS NULL THEN './' || one.i ELSE least(one.i, two.i) || '/' || greatest(one.i, two.i) END AS genotype"
    " FROM gp LEFT JOIN one USING (site, grp) LEFT JOIN two USING (site, grp)) "
)


@query(_GENO + "SELECT site, grp, a0 || ',' || a1 || ',' || a2 AS ad, concat_ws(',', p00, p01, p02, p10, p11, p12, p20, p21, p22) AS pl, genotype, cn FROM gt JOIN gcn USING (site, grp)")
def group_genotypes(spark, sf_dir):
    rows = groups.group_genotypes(A.observations(spark, sf_dir), A.groups(spark, sf_dir))
    return rows.select("site", "grp", F.concat_ws(",", F.col("ad").cast("array<string>")).alias("ad"), F.concat_ws(",", F.flatten("pl").cast("array<string>")).alias("pl"), F.array_join(F.col("genotype").cast("array<string>"), "/", ".").alias("genotype"), "cn")


@query(
    ", tr AS (SELECT site, cell, allele, CASE WHEN f_umi + r_umi >= 6 THEN f_umi + r_umi ELSE 0 END AS n, grp FROM obs JOIN grps USING (cell)), sn AS (SELECT site, grp, count(DISTINCT cell) AS n FROM tr GROUP BY ALL),"
    " sh AS (SELECT a.site, a.allele, sn.grp, coalesce(k, 0) / sn.n::DOUBLE AS share FROM (SELECT DISTINCT site, allele FROM tr) a JOIN sn USING (site) LEFT JOIN (SELECT site, allele, grp, count(DISTINCT cell) FILTER (n > 1) AS k FROM tr GROUP BY ALL) h ON h.site = a.site AND h.allele = a.allele AND h.grp = sn.grp)"
    + " SELECT site, allele, max(grp) FILTER (share >= 0.5) AS grp FROM sh GROUP BY 1, 2 HAVING count(*) FILTER (share >= 0.5) = 1 AND count(*) FILTER (share <= 1 - 0.5::DOUBLE) >= 1"
)
def unique_alleles(spark, sf_dir):
    return variants.unique_alleles(variants.zero_shallow(A.observations(spark, sf_dir), 6), A.groups(spark, sf_dir), 0.5)


@query(
    _GENO + ", k AS (SELECT site, CASE WHEN genotype <> './.' THEN genotype END AS g, count(*) AS k, min(a0 + a1 + a2) AS t FROM gt GROUP BY 1, 2)"
    " SELECT site FROM k GROUP BY 1 HAVING sum(k) > 1 AND count(g) > 1 AND max((g IS NOT NULL AND k = 1)::INT) = 1 AND min(t) >= 50"
)
def informative_sites(spark, sf_dir):
    return groups.informative_sites(groups.group_genotypes(A.observations(spark, sf_dir), A.groups(spark, sf_dir)), 50)


@query(
    ", kn AS (SELECT r_name AS known, cell FROM cellsd JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),"
    " o AS (SELECT known, grp, count(*) AS n FROM kn JOIN grps USING (cell) GROUP BY 1, 2), a AS (SELECT known, count(*) AS k FROM kn GROUP BY 1), b AS (SELECT grp, count(*) AS f FROM grps GROUP BY 1)"
    " SELECT known, grp, coalesce(n, 0)::BIGINT AS overlap, k - overlap AS missed, f - overlap AS wrong, round(overlap / k::DOUBLE, 9) AS recall, round(overlap / f::DOUBLE, 9) AS precision FROM (SELECT * FROM a, b) LEFT JOIN o USING (known, grp)"
)
def precision_recall(spark, sf_dir):
    rows = groups.precision_recall(A.donors(spark, sf_dir).withColumnRenamed("cell", "barcode"), A.groups(spark, sf_dir).withColumnRenamed("cell", "barcode"))
    return rows.select("known", "grp", "overlap", "missed", "wrong", F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


_COST = """, gs AS (SELECT grp AS t, count(*) AS n FROM grps GROUP BY 1),
cg AS (SELECT s1 AS cell, grp AS t, sum(d) AS s FROM sym JOIN grps ON s2 = cell GROUP BY 1, 2),
ev AS (SELECT cell, grp, t, n, coalesce(s, 0) AS s FROM grps CROSS JOIN gs LEFT JOIN cg USING (cell, t))
"""


@query(
    _COST + "SELECT a.cell, a.grp, round(a.s / nullif(a.n - 1, 0) + 3e-9, 7) AS remove_cost, b.t AS \"to\", round(b.s / (b.n + 1) + 3e-9, 7) AS add_cost FROM ev a JOIN"
    " (SELECT * FROM ev WHERE grp <> t QUALIFY row_number() OVER (PARTITION BY cell ORDER BY s / (n + 1), t) = 1) b USING (cell) WHERE a.grp = a.t"
)
def move_costs(spark, sf_dir):
    rows = groups.move_costs(_dist(spark, sf_dir), A.groups(spark, sf_dir))
    off = lambda c: F.round(F.col(c) + F.lit(3e-9), 7).alias(c)  # noqa: E731  the engines round ties differently; the shift leaves none
    return rows.select("cell", "grp", off("remove_cost"), "to", off("add_cost"))


@query(
    ", asg AS (SELECT * FROM grps WHERE cell % 5 <> 0), z AS (SELECT grp, count(*) AS n FROM asg GROUP BY 1),"
    " gg AS (SELECT z.grp, coalesce(sum(d), 0) / any_value(n) AS gd, any_value(n) AS n FROM z LEFT JOIN (SELECT a.grp, d FROM sym JOIN asg a ON s1 = a.cell JOIN asg b ON s2 = b.cell WHERE a.grp = b.grp) x USING (grp) GROUP BY 1)"
    " SELECT cell, grp FROM (SELECT t.cell, gg.grp, coalesce(sum(d), 0) / (any_value(n) + 1) - any_value(gd) AS c FROM (SELECT cell FROM cellsd WHERE cell % 5 = 0) t CROSS JOIN gg LEFT JOIN (SELECT s1, d, grp FROM sym JOIN asg ON s2 = cell) y ON y.s1 = t.cell AND y.grp = gg.grp GROUP BY 1, 2)"
    " QUALIFY row_number() OVER (PARTITION BY cell ORDER BY c, grp) = 1"
)
def redistribute_trash(spark, sf_dir):
    cells = A.listed(spark, sf_dir)
    assign = A.groups(spark, sf_dir, cells).filter("cell % 5 <> 0")
    return groups.redistribute(_dist(spark, sf_dir, known=cells), assign, cells.filter("cell % 5 = 0").select("cell"))


@query(
    ", p AS (SELECT a.grp, s1, s2, d FROM sym JOIN grps a ON s1 = a.cell JOIN grps b ON s2 = b.cell WHERE a.grp = b.grp),"
    " f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY grp, s1 ORDER BY d DESC, s2) = 1) SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY grp ORDER BY d DESC, s1 DESC) = 1"
)
def split_seed_pair(spark, sf_dir):
    cells = A.listed(spark, sf_dir)
    return cluster.farthest_pair(_dist(spark, sf_dir, known=cells), A.groups(spark, sf_dir, cells))


@query()
def bisecting_kmeans(spark, sf_dir):
    assign, trash = cluster.bisecting_kmeans(cluster.checkpointed(_dist(spark, sf_dir, "pow4", None, cluster.IN_ONE_TASK)), A.cells(spark, sf_dir), 3)
    return assign.unionByName(trash.withColumn("grp", F.lit(-1)))


@query()
def recluster(spark, sf_dir):
    cells = A.listed(spark, sf_dir)
    dist = cluster.checkpointed(_dist(spark, sf_dir, "pow4", cells, cluster.IN_ONE_TASK))
    assign, trash = cluster.one_group(cells, dist)
    assign, trash = cluster.recluster(dist, assign, trash, expected=3)
    return assign.unionByName(trash.withColumn("grp", F.lit(-1).cast(dict(assign.dtypes)["grp"])))


@query()
def recluster_kmeans(spark, sf_dir):
    dist = cluster.checkpointed(_dist(spark, sf_dir, "pow4", None, cluster.IN_ONE_TASK))
    assign, trash = cluster.bisecting_kmeans(dist, A.cells(spark, sf_dir), 3)
    assign, trash = cluster.recluster(dist, assign, trash, expected=3)
    return assign.unionByName(trash.withColumn("grp", F.lit(-1).cast(dict(assign.dtypes)["grp"])))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.reads(spark, sf_dir).select(F.col("cell").cast("string").alias("barcode"), F.concat(F.lit("u"), F.col("umi")).alias("umi"), F.col("site").alias("contig_rank"), F.col("l_orderkey").alias("pos"), "l_linenumber")
    return merge.merged({"a": rows.filter("l_linenumber % 2 = 0"), "b": rows.filter("l_linenumber % 2 = 1")})


_RUNS = ", runs AS (SELECT CASE l_linenumber % 2 WHEN 0 THEN 'a' ELSE 'b' END AS sample, CASE l_linenumber % 2 WHEN 0 THEN 'a-' ELSE 'b-' END || cell AS barcode, 'u' || umi AS umi, site AS contig_rank, l_orderkey AS pos, l_linenumber FROM reads)"


@query(_RUNS + " SELECT * FROM runs")
def merge_prefix(spark, sf_dir):
    return merge.coordinate_sorted(_runs(spark, sf_dir), ties=("sample", "l_linenumber", "barcode", "umi"))


_DOUBLETS = _RUNS + """, pk AS (SELECT barcode, row_number() OVER (ORDER BY md5('12345|' || barcode), barcode) - 1 AS k FROM (SELECT DISTINCT barcode FROM runs) QUALIFY k < 10),
dp AS (SELECT k // 2 AS p, string_agg(barcode, '_' ORDER BY barcode) AS doublet FROM pk GROUP BY 1 HAVING count(*) = 2),
db AS (SELECT barcode, doublet FROM pk JOIN dp ON k // 2 = p)
"""


@query(_DOUBLETS + "SELECT * FROM runs UNION ALL SELECT sample, doublet, umi || 'G', contig_rank, pos, l_linenumber FROM runs JOIN db USING (barcode)")
def doublets(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return merge.with_doublets(runs, merge.doublet_pairs(runs, 5))


@query(_DOUBLETS + "SELECT DISTINCT barcode FROM runs UNION ALL SELECT doublet FROM dp")
def merged_barcodes(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return merge.merged_barcodes(runs.select("barcode").distinct(), merge.doublet_pairs(runs, 5))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE ('0x' || substr(md5(concat_ws('|', '12345', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 12))::BIGINT <= 70368744177664", prelude=False)
def downsample(spark, sf_dir):
    return merge.downsampled(A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), 0.25, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query(
    ", fr AS (SELECT DISTINCT cell::VARCHAR AS barcode, 'r' || l_orderkey || '-' || l_partkey || '-' || l_linenumber AS id, l_linestatus = 'O' AS second, l_returnflag AS seq, l_linestatus AS qual FROM reads WHERE cell % 2 = 0 AND l_linenumber <> 3)"
    " SELECT barcode, id, max(seq) FILTER (NOT second) AS r1_seq, max(qual) FILTER (NOT second) AS r1_qual, max(seq) FILTER (second) AS r2_seq, max(qual) FILTER (second) AS r2_qual FROM fr GROUP BY 1, 2"
)
def fastq_pairs(spark, sf_dir):
    rows = A.reads(spark, sf_dir).select(
        F.col("cell").cast("string").alias("barcode"), F.concat(F.lit("r"), "l_orderkey", F.lit("-"), "l_partkey", F.lit("-"), "l_linenumber").alias("name"),
        (F.when(F.col("l_linestatus") == "O", merge.SECOND).otherwise(0) + F.when(F.col("l_linenumber") == 3, merge.SECONDARY).otherwise(0)).alias("flag"), F.col("l_returnflag").alias("seq"), F.col("l_linestatus").alias("qual"),
    )
    listed = A.cells(spark, sf_dir).filter("cell % 2 = 0").select(F.col("cell").cast("string").alias("barcode"))
    return merge.fastq_pairs(merge.fastq_reads(rows, listed))


@query(
    "WITH m AS (SELECT * FROM (SELECT n_nationkey % 5 AS contig, n_nationkey * 7 % 40 AS s, n_nationkey * 7 % 40 + 6 AS e FROM nation)), f AS (SELECT *, max(e) OVER (PARTITION BY contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM m),"
    " i AS (SELECT *, sum(CASE WHEN s <= far THEN 0 ELSE 1 END) OVER (PARTITION BY contig ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM f) SELECT contig, min(s) AS \"start\", max(e) AS \"end\" FROM i GROUP BY contig, g",
    prelude=False,
)
def merged_regions(spark, sf_dir):
    n = A.table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 5).alias("contig"), (F.col("n_nationkey") * 7 % 40).alias("start"))
    return R.merged_regions(n.withColumn("end", F.col("start") + 6))


_CIGAR_READS = [("r1", 1, "AATTCCGGA", "123456789", "3M1D3M3M"), ("r2", 1, "AATTCCGGAA", "1234567890", "3M1D3M1I3M"), ("r3", 5, "AATTC", "12345", "1S2M3N2M"), ("r4", 5, None, None, None)]
_CIGAR_ROWS = [
    *[("r1", p, a, q, d) for p, a, q, d in [(1, "A", "1", 0), (2, "A", "2", 0), (3, "T", "3", 1), (4, "", "", 0), (5, "T", "4", 0), (6, "C", "5", 0), (7, "C", "6", 0), (8, "G", "7", 0), (9, "G", "8", 0), (10, "A", "9", 0)]],
    *[("r2", p, a, q, d) for p, a, q, d in [(1, "A", "1", 0), (2, "A", "2", 0), (3, "T", "3", 1), (4, "", "", 0), (5, "T", "4", 0), (6, "C", "5", 0), (7, "CG", "67", 0), (8, "G", "8", 0), (9, "A", "9", 0), (10, "A", "0", 0)]],
    *[("r3", p, a, q, d) for p, a, q, d in [(5, "A", "2", 0), (6, "T", "3", 0), (10, "T", "4", 0), (11, "C", "5", 0)]],
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {p}, '{a}', '{q}', {d})" for n, p, a, q, d in _CIGAR_ROWS) + ") t(name, position, allele, quals, del_bases)", prelude=False)
def cigar_bases(spark, sf_dir):
    reads = spark.createDataFrame(_CIGAR_READS, "name string, pos int, seq string, qual string, cigar string")
    return R.cigar_bases(reads, ["name"])


_SITES = [("c1", 2, 0, "C", 0, 3, 1), ("c2", 2, 0, "A", 2, 2, 0), ("c2", 2, 1, "A", 0, 5, 5), ("c3", 2, 0, "A", 2, 1, 1), ("c3", 2, 1, "AG", 0, 2, 2), ("c3", 2, 1, "ACA", 0, 4, 0)]


@query("SELECT * FROM (VALUES ('c1', 2, 0, 'A', 'C', 3, 1), ('c2', 2, 0, 'ACA', 'A', 2, 0), ('c2', 2, 1, 'ACA', 'ACA', 5, 5), ('c3', 2, 0, 'ACA', 'A', 1, 1), ('c3', 2, 1, 'ACA', 'AGA', 2, 2), ('c3', 2, 1, 'ACA', 'ACA', 4, 0)) t(contig, pos, cell, ref, text, f_umi, r_umi)", prelude=False)
def site_alleles(spark, sf_dir):
    rows = spark.createDataFrame(_SITES, "contig string, pos int, cell int, allele string, del_bases int, f_umi int, r_umi int").withColumns({"f_reads": F.col("f_umi"), "r_reads": F.col("r_umi")})
    reference = spark.createDataFrame([(c, "GACAGGT") for c in ("c1", "c2", "c3")], "contig string, seq string")
    return R.site_alleles(rows, reference).drop("f_reads", "r_reads")
