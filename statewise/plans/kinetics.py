"""Queries of models of states: estimation, spectra, propagation, path theory, lumping, profiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from statewise.functions import linalg
from statewise.operators import counting as c
from statewise.operators import lumping, model, paths
from statewise.operators.matrix import MOST_STATES, from_dense, from_vector, to_dense
from statewise.plans.counting import COUNTS, EVENTS, HELD, counts1, event_states, held
from statewise.plans.registry import query

#: SQL of the symmetric transition matrix of the event states, its populations, and the states.
TPROB = EVENTS.replace("WITH", "WITH RECURSIVE", 1) + COUNTS.format(lag=1) + """,
y AS (SELECT i, j, sum(c) / 2 AS c FROM (SELECT i, j, c FROM c UNION ALL SELECT j, i, c FROM c) GROUP BY 1, 2),
t AS (SELECT i, j, c / sum(c) OVER (PARTITION BY i) AS p FROM y),
pi AS (SELECT i, sum(c) / (SELECT sum(c) FROM y) AS v FROM y GROUP BY 1),
n AS (SELECT DISTINCT i FROM t)"""
#: Committors to state 4 from state 0, and passage times to state 4, by fixed-point rounds.
Q = """, qr(k, i, v) AS (SELECT 0, i, CASE WHEN i = 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM n UNION ALL
SELECT k + 1, t.i, CASE WHEN t.i = 0 THEN 0.0 WHEN t.i = 4 THEN 1.0 ELSE sum(t.p * qr.v) END FROM qr JOIN t ON t.j = qr.i WHERE k < 150 GROUP BY k, t.i),
q AS (SELECT i, v FROM qr WHERE k = 150)"""
M = """, mr(k, i, v) AS (SELECT 0, i, 0.0::DOUBLE FROM n UNION ALL
SELECT k + 1, t.i, CASE WHEN t.i = 4 THEN 0.0 ELSE 1 + sum(t.p * mr.v) END FROM mr JOIN t ON t.j = mr.i WHERE k < 400 GROUP BY k, t.i),
m AS (SELECT i, v FROM mr WHERE k = 400)"""
FLUX = ", f AS (SELECT t.i, t.j, pi.v * (1 - a.v) * t.p * b.v AS f FROM t JOIN pi USING (i) JOIN q a ON a.i = t.i JOIN q b ON b.i = t.j WHERE t.i <> t.j)"


#: SQL of the spectrum of the symmetric matrix D^1/2 T D^-1/2 of the event states (D: populations) at several lags: ``eig(lag, m, lam)`` and the
#: projectors ``proj(lag, m, i, j, v)``. The first is known from the populations; the others are found one after another by squaring what is
#: left until one projector remains.
STATES = 5


def spectrum(lags=(1,)):
    sql = EVENTS.replace("WITH", "WITH RECURSIVE", 1)
    sql += ", c AS (" + " UNION ALL ".join(f"SELECT {k} AS lag, a.state AS i, b.state AS j, count(*) AS c FROM s a JOIN s b ON a.traj_id = b.traj_id AND b.frame = a.frame + {k} WHERE a.state IS NOT NULL AND b.state IS NOT NULL GROUP BY 2, 3" for k in lags) + ")"
    sql += """,
y AS (SELECT lag, i, j, sum(c) / 2 AS c FROM (SELECT * FROM c UNION ALL SELECT lag, j, i, c FROM c) GROUP BY 1, 2, 3),
pi AS (SELECT lag, i, sum(c) / sum(sum(c)) OVER (PARTITION BY lag) AS v FROM y GROUP BY 1, 2),
tot AS (SELECT lag, sum(c) AS n FROM y GROUP BY 1),
full_ AS (SELECT a.lag, a.i, b.i AS j, a.v AS pa, b.v AS pb FROM pi a JOIN pi b ON a.lag = b.lag),
b0 AS MATERIALIZED (SELECT f.lag, f.i, f.j, coalesce(y.c / n, 0)::DOUBLE / sqrt(pa * pb) AS v FROM full_ f JOIN tot USING (lag) LEFT JOIN y ON y.lag = f.lag AND y.i = f.i AND y.j = f.j),
p0 AS MATERIALIZED (SELECT lag, i, j, sqrt(pa * pb) AS v FROM full_), l0 AS (SELECT lag, 1.0::DOUBLE AS lam FROM tot)"""
    for m in range(1, STATES):
        sql += f""",
b{m} AS MATERIALIZED (SELECT b.lag, b.i, b.j, b.v - l.lam * p.v AS v FROM b{m - 1} b JOIN p{m - 1} p USING (lag, i, j) JOIN l{m - 1} l USING (lag)),
w{m}(k, lag, i, j, v) AS (SELECT 0, lag, i, j, v / sqrt(sum(v * v) OVER (PARTITION BY lag)) FROM b{m} UNION ALL
SELECT k + 1, lag, i, j, v / sqrt(sum(v * v) OVER (PARTITION BY lag)) FROM (SELECT x.k, x.lag, x.i, z.j, sum(x.v * z.v) AS v FROM w{m} x JOIN w{m} z ON x.lag = z.lag AND x.j = z.i WHERE x.k < 45 GROUP BY 1, 2, 3, 4)),
p{m} AS MATERIALIZED (SELECT w.lag, i, j, v / tr AS v FROM w{m} w JOIN (SELECT lag, sum(v) AS tr FROM w{m} WHERE k = 45 AND i = j GROUP BY 1) t ON t.lag = w.lag WHERE k = 45),
l{m} AS MATERIALIZED (SELECT p.lag, sum(p.v * b.v) AS lam FROM p{m} p JOIN b{m} b ON b.lag = p.lag AND b.i = p.j AND b.j = p.i GROUP BY 1)"""
    sql += ", raw_ AS (" + " UNION ALL ".join(f"SELECT lag, {m} AS m0, lam FROM l{m}" for m in range(STATES)) + ")"
    sql += ", eig AS (SELECT lag, m0, CAST(row_number() OVER (PARTITION BY lag ORDER BY lam DESC) - 1 AS INT) AS m, lam FROM raw_)"
    return sql + ", proj AS (SELECT r.lag, e.m, e.lam, r.i, r.j, r.v FROM (" + " UNION ALL ".join(f"SELECT lag, {m} AS m0, i, j, v FROM p{m}" for m in range(STATES)) + ") r JOIN eig e USING (lag, m0))"


def event_model(spark, folder):
    return model.build(to_dense(counts1(spark, folder, event_states), "c"), "transpose", trim=False)


def frames_model(spark, folder, kind="mle"):
    """The model of the corrected assignments over the states in use, and the state of each of its rows (trimming drops some)."""
    states = held(spark, folder)
    numbers = c.renumbering(states)
    used = numbers.orderBy("new").select("old").limit(MOST_STATES + 1).toArrow()["old"].to_numpy()
    m = model.build(to_dense(counts1(spark, folder, lambda *_: c.apply_mapping(states, numbers)), "c", len(used)), kind)
    return m, used[m.mapping >= 0]


def rounded(df, value="v", places=6):
    return df.withColumn(value, F.round(value, places))


@query("build_msm_transpose", TPROB + " SELECT i, j, round(p, 9) AS p FROM t")
def build_msm(spark, folder):
    return rounded(from_dense(spark, event_model(spark, folder).tprob, "p"), "p", 9)


#: SQL of the assignments' counts in the ergodic component, and of the reversible likelihood's fixed point after many rounds.
ERGODIC = HELD.replace("WITH", "WITH RECURSIVE", 1) + COUNTS.format(lag=1) + """,
n AS (SELECT i FROM c UNION SELECT j FROM c), g AS (SELECT DISTINCT i, j FROM c UNION SELECT i, i FROM n),
r(i, j) AS (SELECT i, j FROM g UNION SELECT r.i, g.j FROM r JOIN g ON r.j = g.i),
k AS (SELECT a.i, min(a.j) AS label FROM r a JOIN r b ON a.i = b.j AND a.j = b.i GROUP BY 1),
w AS (SELECT label, sum(c) AS w FROM c JOIN k ON c.j = k.i GROUP BY 1),
best AS (SELECT label FROM w ORDER BY w DESC, label LIMIT 1),
kept AS (SELECT i FROM k WHERE label = (SELECT label FROM best)),
e AS (SELECT * FROM c WHERE i IN (SELECT i FROM kept) AND j IN (SELECT i FROM kept))"""
MLE = ERGODIC + """,
en AS (SELECT i, sum(c)::DOUBLE AS n FROM e GROUP BY 1), eb AS (SELECT i, j, sum(c)::DOUBLE AS b FROM (SELECT i, j, c FROM e UNION ALL SELECT j, i, c FROM e) GROUP BY 1, 2),
x(k, i, j, b, ni, nj, x) AS (SELECT 0, eb.i, eb.j, b, a.n, z.n, b / 2 FROM eb JOIN en a ON a.i = eb.i JOIN en z ON z.i = eb.j UNION ALL
SELECT k + 1, i, j, b, ni, nj, b / (ni / sum(x) OVER (PARTITION BY i) + nj / sum(x) OVER (PARTITION BY j)) FROM x WHERE k < 1200)"""


@query("build_msm_mle", MLE + " SELECT i, j, round(x / sum(x) OVER (PARTITION BY i), 7) AS p FROM x WHERE k = 1200")
def build_msm_mle(spark, folder):
    m, names = frames_model(spark, folder)
    return rounded(from_dense(spark, m.tprob, "p", names=names), "p", 7)


@query("assignments_mfpt", ERGODIC + """,
y AS (SELECT i, j, sum(c) / 2 AS c FROM (SELECT i, j, c FROM e UNION ALL SELECT j, i, c FROM e) GROUP BY 1, 2),
t AS (SELECT i, j, c / sum(c) OVER (PARTITION BY i) AS p FROM y),
mr(k, i, v) AS (SELECT 0, i, 0.0::DOUBLE FROM kept UNION ALL
SELECT k + 1, t.i, CASE WHEN t.i = (SELECT min(i) FROM kept) THEN 0.0 ELSE 1 + sum(t.p * mr.v) END FROM mr JOIN t ON t.j = mr.i WHERE k < 9000 GROUP BY k, t.i)
SELECT i, round(v, 3) AS v FROM mr WHERE k = 9000""")
def assignments_mfpt(spark, folder):
    """Passage time from every state of the assignments' model to its smallest state."""
    m, names = frames_model(spark, folder, "transpose")
    return rounded(from_vector(spark, paths.mfpt(0, m.tprob), names=names), "v", 3)


# The fixed point of the reversible likelihood by a fixed number of rounds, as the SQL unrolls it.
ROUNDS = 30
_mle = EVENTS + COUNTS.format(lag=1) + ", n AS (SELECT i, sum(c)::DOUBLE AS n FROM c GROUP BY 1), b AS (SELECT i, j, sum(c)::DOUBLE AS b FROM (SELECT i, j, c FROM c UNION ALL SELECT j, i, c FROM c) GROUP BY 1, 2), x0 AS (SELECT i, j, b / 2 AS x FROM b)"
for _k in range(1, ROUNDS + 1):
    _mle += f", r{_k} AS (SELECT i, sum(x) AS r FROM x{_k - 1} GROUP BY 1), x{_k} AS MATERIALIZED (SELECT b.i, b.j, b / (ni.n / ri.r + nj.n / rj.r) AS x FROM b JOIN n ni ON ni.i = b.i JOIN n nj ON nj.i = b.j JOIN r{_k} ri ON ri.i = b.i JOIN r{_k} rj ON rj.i = b.j)"
_mle += f" SELECT i, j, round(x * (SELECT sum(n) FROM n) / (SELECT sum(x) FROM x{ROUNDS}), 6) AS c FROM x{ROUNDS}"


@query("mle_reversible_counts", _mle)
def mle_reversible(spark, folder):
    counts = to_dense(counts1(spark, folder, event_states), "c")
    return rounded(from_dense(spark, linalg.reversible_counts(counts, ROUNDS, 0.0), "c"), "c")


@query("ergodic_trim", HELD.replace("WITH", "WITH RECURSIVE", 1) + COUNTS.format(lag=1) + """,
n AS (SELECT i FROM c UNION SELECT j FROM c), g AS (SELECT DISTINCT i, j FROM c UNION SELECT i, i FROM n),
r(i, j) AS (SELECT i, j FROM g UNION SELECT r.i, g.j FROM r JOIN g ON r.j = g.i),
k AS (SELECT a.i, min(a.j) AS label FROM r a JOIN r b ON a.i = b.j AND a.j = b.i GROUP BY 1),
w AS (SELECT label, sum(c) AS w FROM c JOIN k ON c.j = k.i GROUP BY 1),
best AS (SELECT label FROM w ORDER BY w DESC, label LIMIT 1)
SELECT k.i AS old, CASE WHEN k.label = (SELECT label FROM best) THEN CAST(row_number() OVER (PARTITION BY k.label = (SELECT label FROM best) ORDER BY k.i) - 1 AS INT) END AS new FROM k""")
def ergodic_trim(spark, folder):
    states = held(spark, folder)
    counts = counts1(spark, folder)
    names = counts.select("i").union(counts.select("j")).distinct()
    from pyspark.sql import Window

    dense = names.select(F.col("i").alias("old"), (F.row_number().over(Window.orderBy("i")) - 1).alias("k"))
    mapped = c.transition_counts(c.apply_mapping(states, dense.select("old", F.col("k").alias("new"))), [1]).select("i", "j", "c")
    mapping = from_vector(spark, linalg.ergodic(to_dense(mapped, "c", names.count())), "new")
    return dense.join(mapping, dense["k"] == mapping["i"]).select("old", F.when(F.col("new") >= 0, F.col("new").cast("int")).alias("new"))


@query("propagate_model", TPROB + ", pr(k, i, v) AS (SELECT 0, i, CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM n UNION ALL SELECT k + 1, t.j, sum(pr.v * t.p) FROM pr JOIN t ON t.i = pr.i WHERE k < 3 GROUP BY k, t.j) SELECT i, round(v, 9) AS v FROM pr WHERE k = 3")
def propagate_model(spark, folder):
    m = event_model(spark, folder)
    return rounded(from_vector(spark, model.propagate(m.tprob, np.eye(len(m.tprob))[0], 3)[0]), "v", 9)


@query("observable_series", TPROB + ", pr(k, i, v) AS (SELECT 0, i, CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM n UNION ALL SELECT k + 1, t.j, sum(pr.v * t.p) FROM pr JOIN t ON t.i = pr.i WHERE k < 9 GROUP BY k, t.j) SELECT CAST(k AS INT) AS i, round(sum(v * i), 9) AS v FROM pr GROUP BY k")
def observable_series(spark, folder):
    m = event_model(spark, folder)
    n = len(m.tprob)
    return rounded(from_vector(spark, model.propagate(m.tprob, np.eye(n)[0], 10, np.arange(n, dtype=float))[1]), "v", 9)


@query("stationary_distribution", TPROB + " SELECT i, round(v, 9) AS v FROM pi")
def stationary_distribution(spark, folder):
    return rounded(from_vector(spark, linalg.stationary(event_model(spark, folder).tprob)), "v", 9)


@query("committors", TPROB + Q + " SELECT i, round(v, 6) AS v FROM q")
def committors(spark, folder):
    return rounded(from_vector(spark, paths.committors(0, 4, event_model(spark, folder).tprob)))


@query("fluxes", TPROB + Q + FLUX + " SELECT i, j, round(f, 9) AS f FROM f WHERE f > 0")
def fluxes(spark, folder):
    m = event_model(spark, folder)
    return rounded(from_dense(spark, paths.fluxes(0, 4, m.tprob, m.populations), "f"), "f", 9)


@query("net_fluxes", TPROB + Q + FLUX + " SELECT a.i, a.j, round(a.f - coalesce(b.f, 0), 9) AS f FROM f a LEFT JOIN f b ON a.i = b.j AND a.j = b.i WHERE round(a.f - coalesce(b.f, 0), 9) > 0")
def net_fluxes(spark, folder):
    m = event_model(spark, folder)
    return rounded(from_dense(spark, paths.net_fluxes(0, 4, m.tprob, m.populations), "f"), "f", 9).where("f > 0")


@query("mfpt_to_sink", TPROB + M + " SELECT i, round(v, 6) AS v FROM m")
def mfpt_to_sink(spark, folder):
    return rounded(from_vector(spark, paths.mfpt(4, event_model(spark, folder).tprob)))


@query("ensemble_mfpt", TPROB + M + " SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation FROM m WHERE i IN (0, 1)")
def ensemble_mfpt(spark, folder):
    mean, sd = paths.ensemble_mfpt([0, 1], [4], event_model(spark, folder).tprob)
    return spark.createDataFrame([(round(mean, 6), round(sd, 6))], "mean double, deviation double")


@query("all_pairs_mfpt", TPROB + """, mr(k, s, i, v) AS (SELECT 0, b.i, a.i, 0.0::DOUBLE FROM n a, n b UNION ALL
SELECT k + 1, mr.s, t.i, CASE WHEN t.i = mr.s THEN 0.0 ELSE 1 + sum(t.p * mr.v) END FROM mr JOIN t ON t.j = mr.i WHERE k < 400 GROUP BY k, mr.s, t.i)
SELECT i, s AS j, round(v, 6) AS v FROM mr WHERE k = 400""")
def all_pairs_mfpt(spark, folder):
    m = event_model(spark, folder)
    return rounded(from_dense(spark, paths.all_mfpts(m.tprob, m.populations), "v", keep_zero=True))


NET = ", g0 AS MATERIALIZED (SELECT a.i, a.j, a.f - coalesce(b.f, 0) AS f FROM f a LEFT JOIN f b ON a.i = b.j AND a.j = b.i WHERE a.f > coalesce(b.f, 0))"
TOP = TPROB + Q + FLUX + NET
for _k in range(1, 6):
    TOP += f""", p{_k}(nodes, last, f) AS (SELECT [0], 0, 1e9::DOUBLE UNION ALL SELECT list_append(nodes, g.j), g.j, least(p.f, g.f) FROM p{_k} p JOIN g{_k - 1} g ON g.i = p.last WHERE NOT list_contains(nodes, g.j) AND p.last <> 4),
e{_k} AS MATERIALIZED (SELECT g.i, g.j, g.f FROM g{_k - 1} g WHERE g.f = (SELECT max(f) FROM p{_k} WHERE last = 4)), g{_k} AS MATERIALIZED (SELECT * FROM g{_k - 1} WHERE (i, j) NOT IN (SELECT (i, j) FROM e{_k}))"""
TOP += " SELECT * FROM (" + " UNION ALL ".join(f"SELECT {_k - 1} AS rank, round(f, 9) AS flux, i AS b1, j AS b2 FROM e{_k}" for _k in range(1, 6)) + ")"


@query("path_bottleneck", TOP)
def path_bottleneck(spark, folder):
    """Flux and bottleneck edge of the five widest paths; which of several equally wide paths is taken does not change them."""
    m = event_model(spark, folder)
    rows = [(n, round(f, 9), i, j) for n, (_, f, i, j) in enumerate(paths.top_paths(0, 4, m.tprob, 5))]
    return spark.createDataFrame(rows, "rank int, flux double, b1 int, b2 int")


@query("widest_path", TPROB + Q + FLUX + """, g AS (SELECT a.i, a.j, a.f - coalesce(b.f, 0) AS f FROM f a LEFT JOIN f b ON a.i = b.j AND a.j = b.i WHERE a.f > coalesce(b.f, 0)),
w(nodes, last, f) AS (SELECT [0], 0, 1e9::DOUBLE UNION ALL SELECT list_append(nodes, g.j), g.j, least(w.f, g.f) FROM w JOIN g ON g.i = w.last WHERE NOT list_contains(nodes, g.j) AND w.last <> 4)
SELECT round(max(f), 9) AS flux FROM w WHERE last = 4""")
def widest_path(spark, folder):
    m = event_model(spark, folder)
    _, width = paths.widest_path(0, 4, paths.net_fluxes(0, 4, m.tprob, m.populations))
    return spark.createDataFrame([(round(width, 9),)], "flux double")


@query("hub_scores", TPROB + """, a(k, src, dst, i, v) AS (SELECT 0, x.i, z.i, n.i, CASE WHEN n.i = z.i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM n x, n z, n WHERE x.i <> z.i UNION ALL
SELECT k + 1, src, dst, t.i, CASE WHEN t.i = src THEN 0.0 WHEN t.i = dst THEN 1.0 ELSE sum(t.p * a.v) END FROM a JOIN t ON t.j = a.i WHERE k < 150 GROUP BY k, src, dst, t.i),
b(k, w, src, dst, i, v) AS (SELECT 0, y.i, x.i, z.i, n.i, CASE WHEN n.i = y.i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM n x, n z, n y, n WHERE x.i <> z.i AND y.i <> x.i AND y.i <> z.i UNION ALL
SELECT k + 1, w, src, dst, t.i, CASE WHEN t.i IN (src, dst) THEN 0.0 WHEN t.i = w THEN 1.0 ELSE sum(t.p * b.v) END FROM b JOIN t ON t.j = b.i WHERE k < 150 GROUP BY k, w, src, dst, t.i),
up AS (SELECT w, src, dst, sum(t.p * b.v) AS u FROM b JOIN t ON t.i = b.src AND t.j = b.i WHERE k = 150 AND t.j <> b.src GROUP BY 1, 2, 3),
down AS (SELECT src, dst, sum(t.p * a.v) AS d FROM a JOIN t ON t.i = a.src AND t.j = a.i WHERE k = 150 AND t.j <> a.src GROUP BY 1, 2)
SELECT w AS i, round(avg(u * a.v / d), 6) AS v FROM up JOIN down USING (src, dst) JOIN a ON a.k = 150 AND a.src = up.src AND a.dst = up.dst AND a.i = up.w GROUP BY 1""")
def hub_scores(spark, folder):
    return rounded(from_vector(spark, paths.hub_scores(event_model(spark, folder).tprob)))


@query("fraction_visits", TPROB + """, a(k, i, v) AS (SELECT 0, i, CASE WHEN i = 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM n UNION ALL
SELECT k + 1, t.i, CASE WHEN t.i = 0 THEN 0.0 WHEN t.i = 4 THEN 1.0 ELSE sum(t.p * a.v) END FROM a JOIN t ON t.j = a.i WHERE k < 150 GROUP BY k, t.i),
b(k, i, v) AS (SELECT 0, i, CASE WHEN i = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM n UNION ALL
SELECT k + 1, t.i, CASE WHEN t.i IN (0, 4) THEN 0.0 WHEN t.i = 2 THEN 1.0 ELSE sum(t.p * b.v) END FROM b JOIN t ON t.j = b.i WHERE k < 150 GROUP BY k, t.i)
SELECT round((SELECT sum(t.p * b.v) FROM t JOIN b ON b.i = t.j AND b.k = 150 WHERE t.i = 0 AND t.j <> 0) * (SELECT v FROM a WHERE k = 150 AND i = 2) /
(SELECT sum(t.p * a.v) FROM t JOIN a ON a.i = t.j AND a.k = 150 WHERE t.i = 0 AND t.j <> 0), 6) AS fraction""")
def fraction_visits(spark, folder):
    f = float(paths.fraction_visits(event_model(spark, folder).tprob, 2, 0, 4))
    return spark.createDataFrame([(round(f, 6),)], "fraction double")


def _timescales(counts):
    """``lag, k, timescale`` of long counts; each lag's matrix is solved in its own task. Eigenvalues that are not positive have none."""
    import pandas as pd

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(max(pdf["i"].max(), pdf["j"].max())) + 1
        if n > MOST_STATES:
            raise ValueError(f"{n} states; a model has at most {MOST_STATES}")
        dense = np.zeros((n, n))
        dense[pdf["i"], pdf["j"]] = pdf["c"]
        lag = int(pdf["lag"].iloc[0])
        t = model.implied_timescales(dense, lag, 5, "transpose")
        return pd.DataFrame({"lag": lag, "k": np.arange(1, len(t) + 1), "timescale": np.round(t, 6)})

    found = counts.groupBy("lag").applyInPandas(solve, "lag int, k int, timescale double")
    return found.withColumn("timescale", F.when(~F.isnan("timescale"), F.col("timescale")))


@query("implied_timescales")
def implied_timescales(spark, folder):
    """All lags are counted in one pass."""
    states = held(spark, folder)
    return _timescales(c.transition_counts(c.apply_mapping(states, c.renumbering(states)), [1, 2, 5, 10]))


@query("event_timescales", spectrum((1, 2, 5)) + " SELECT lag, m AS k, CASE WHEN lam > 0 THEN round(-lag / ln(lam), 6) END AS timescale FROM eig WHERE m > 0")
def event_timescales(spark, folder):
    return _timescales(c.transition_counts(event_states(spark, folder), [1, 2, 5]))


@query("eigenvalues", spectrum() + " SELECT m AS i, round(lam, 6) AS v FROM eig")
def eigenvalues(spark, folder):
    m = event_model(spark, folder)
    return rounded(from_vector(spark, linalg.reversible_eigenvectors(m.tprob, 5, m.populations)[0]))


@query("assignments_spectrum")
def assignments_spectrum(spark, folder):
    m, _ = frames_model(spark, folder, "transpose")
    return rounded(from_vector(spark, linalg.reversible_eigenvectors(m.tprob, 10, m.populations)[0]))


@query("eigen_amplitudes", spectrum() + " SELECT m - 1 AS k, CASE WHEN any_value(lam) > 0 THEN round(-1 / ln(any_value(lam)), 6) END AS timescale, round(sqrt(greatest(sum(p.i * p.j * p.v / sqrt(a.v * b.v)), 0)), 6) AS amplitude FROM proj p JOIN pi a ON a.i = p.i JOIN pi b ON b.i = p.j WHERE m > 0 GROUP BY m")
def eigen_amplitudes(spark, folder):
    m = event_model(spark, folder)
    t, a = model.project_observable(np.arange(len(m.tprob), dtype=float), m.tprob, 5)
    return spark.createDataFrame([(k, None if np.isnan(x) else round(float(x), 6), round(abs(float(y)), 6)) for k, (x, y) in enumerate(zip(t, a, strict=True))], "k int, timescale double, amplitude double")


@query("autocorrelation", spectrum() + ", sq AS (SELECT m, any_value(lam) AS lam, sum(p.i * p.j * p.v * sqrt(a.v * b.v)) AS s2 FROM proj p JOIN pi a ON a.i = p.i JOIN pi b ON b.i = p.j WHERE m > 0 GROUP BY m) SELECT CAST(k AS INT) AS i, round(sum(pow(greatest(lam, 0), k) * s2) / sum(s2), 6) AS v FROM sq, range(20) r(k) GROUP BY k")
def autocorrelation(spark, folder):
    m = event_model(spark, folder)
    return rounded(from_vector(spark, model.autocorrelation(m.tprob, np.arange(len(m.tprob), dtype=float), np.arange(20))))


@query("expectation_series", spectrum() + ", am AS (SELECT m, any_value(lam) AS lam, sum(0.2 / sqrt(a.v) * p.v * sqrt(b.v) * p.j) AS w FROM proj p JOIN pi a ON a.i = p.i JOIN pi b ON b.i = p.j GROUP BY m) SELECT CAST(k AS INT) AS i, round(sum(pow(lam, k) * w), 6) AS v FROM am, range(20) r(k) WHERE lam > 0 GROUP BY k")
def expectation_series(spark, folder):
    m = event_model(spark, folder)
    return rounded(from_vector(spark, model.expectation_series(m.tprob, np.arange(len(m.tprob), dtype=float), 20)))


@query("markov_walk")
def markov_walk(spark, folder):
    return from_vector(spark, model.walk(event_model(spark, folder).tprob, 0, 1000, seed=3), "state")


@query("sample_trajectory")
def sample_trajectory(spark, folder):
    """A walk over the states of the model, and for every visit a frame of its state drawn anew."""
    m, names = frames_model(spark, folder)
    visited = names[model.walk(m.tprob, None, 200, seed=3)]
    walk = spark.createDataFrame([(k, int(x)) for k, x in enumerate(visited)], "step int, state int")
    return c.draws(held(spark, folder), walk.select("state", F.col("step").alias("draw")), seed=4).select(F.col("draw").alias("step"), "state", "traj_id", "frame")


@query("pcca")
def pcca(spark, folder):
    m, names = frames_model(spark, folder)
    return from_vector(spark, lumping.pcca(m.tprob, 5), "macro", names).selectExpr("i as state", "cast(macro as int) as macro")


@query("event_pcca", spectrum() + """, v AS (SELECT m, i, pv / sqrt(pi.v) / sqrt(sum(CASE WHEN i = 0 THEN pv END) OVER (PARTITION BY m)) AS x FROM (SELECT m, i, v AS pv FROM proj WHERE j = 0) q JOIN pi USING (i)),
a1 AS (SELECT i, CASE WHEN x >= 1e-5 THEN 1 ELSE 0 END AS l FROM v WHERE m = 1),
s2 AS (SELECT l FROM (SELECT l, max(x) - min(x) AS w FROM v JOIN a1 USING (i) WHERE m = 2 GROUP BY 1) ORDER BY w DESC, l LIMIT 1)
SELECT i AS state, CASE WHEN l = (SELECT l FROM s2) AND x >= 1e-5 THEN 2 ELSE l END AS macro FROM a1 JOIN v USING (i) WHERE m = 2""")
def event_pcca(spark, folder):
    return from_vector(spark, lumping.pcca(event_model(spark, folder).tprob, 3), "macro").selectExpr("i as state", "cast(macro as int) as macro")


@query("pcca_plus")
def pcca_plus(spark, folder):
    m, names = frames_model(spark, folder)
    return from_vector(spark, lumping.pcca_plus(m.tprob, 4)[0], "macro", names).selectExpr("i as state", "cast(macro as int) as macro")


@query("bace")
def bace(spark, folder):
    m = to_dense(c.transition_counts(event_states(spark, folder), [1]).select("i", "j", "c"), "c")
    return from_vector(spark, lumping.bace(m, 3)[0], "macro").selectExpr("i", "cast(macro as int) as macro")


@query("rate_fit")
def rate_fit(spark, folder):
    m = event_model(spark, folder)
    k = model.fit_rates(m.counts, m.populations, model.rates_of(m.tprob), rounds=400)
    return rounded(from_dense(spark, k, "k"), "k", 4)


CFEP = TPROB + Q + ", o AS (SELECT q.i, q.v AS q, row_number() OVER (ORDER BY q.v, q.i) AS r FROM q), d AS (SELECT a.i AS i, b.i AS j, y.c, a.r AS ra, b.r AS rb FROM y JOIN o a ON a.i = y.i JOIN o b ON b.i = y.j)"


@query("cfep_partition", CFEP + " SELECT o.i, round((SELECT sum(c) FROM d WHERE d.j = o.i), 6) AS zh, round((SELECT coalesce(sum(c), 0) FROM d WHERE ra <= o.r AND rb > o.r), 6) AS zc FROM o")
def cfep_partition(spark, folder):
    m = event_model(spark, folder)
    order, zh, zc = paths.cut_profile(m.counts, paths.committors(0, 4, m.tprob))
    return spark.createDataFrame([(int(i), round(float(a), 6), round(float(b), 6) + 0.0) for i, a, b in zip(order, zh, zc, strict=True)], "i int, zh double, zc double")


@query("cfep_natural", CFEP + ", z AS (SELECT o.r, o.i, (SELECT sum(c) FROM d WHERE d.j = o.i) AS zh, (SELECT coalesce(sum(c), 0) FROM d WHERE ra <= o.r AND rb > o.r) AS zc FROM o) SELECT i, round(sum(zh / (zc * sqrt(pi()))) OVER (ORDER BY r), 6) AS v FROM z WHERE zc > 1e-12")
def cfep_natural(spark, folder):
    m = event_model(spark, folder)
    order, x, _ = paths.natural_coordinate(m.counts, paths.committors(0, 4, m.tprob))
    return spark.createDataFrame([(int(i), round(float(v), 6)) for i, v in zip(order, x, strict=True)], "i int, v double")


@query("cfep_histogram", TPROB + Q + ", h AS (SELECT least(CAST(floor(q.v * 15) AS INT), 14) AS b, sum(pi.v) AS w FROM q JOIN pi USING (i) GROUP BY 1) SELECT round(e.b / 15.0, 6) AS edge, round(-ln(w), 6) AS energy FROM range(15) e(b) LEFT JOIN h ON h.b = e.b")
def cfep_histogram(spark, folder):
    m = event_model(spark, folder)
    edges, energy = paths.profile_histogram(m.populations, paths.committors(0, 4, m.tprob), 15)
    return spark.createDataFrame([(round(float(a), 6), None if np.isnan(b) else round(float(b), 6)) for a, b in zip(edges, energy, strict=True)], "edge double, energy double")


@query("cfep_mfpt", CFEP + """, z0 AS (SELECT o.r, o.q, (SELECT sum(c) FROM d WHERE d.j = o.i) AS zh, (SELECT coalesce(sum(c), 0) FROM d WHERE ra <= o.r AND rb > o.r) AS zc FROM o),
z AS (SELECT r, q, zh, CASE WHEN zc > 1e-12 THEN zc ELSE lag(zc) OVER (ORDER BY r) END AS zc FROM z0),
s1 AS (SELECT *, coalesce((q - lag(q) OVER (ORDER BY r)) * (zh + lag(zh) OVER (ORDER BY r)) / 2, 0) AS a FROM z),
s2 AS (SELECT q, r, zh / (zc * zc) * sum(a) OVER (ORDER BY r) AS g FROM s1)
SELECT round(sum(b) / pi(), 6) AS v FROM (SELECT (q - lag(q) OVER (ORDER BY r)) * (g + lag(g) OVER (ORDER BY r)) / 2 AS b FROM s2)""")
def cfep_mfpt(spark, folder):
    m = event_model(spark, folder)
    return spark.createDataFrame([(round(paths.profile_mfpt(m.counts, paths.committors(0, 4, m.tprob), 0, 4), 6),)], "v double")
