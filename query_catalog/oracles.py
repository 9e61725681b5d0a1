"""The same results as plain SQL, for comparison.

Nothing here calls the engine: the keyed random numbers, the descent steps and
the inverse square root of a Gram matrix are written out as SQL.
"""

from __future__ import annotations

import math

from hingeworks.plans.sweep import (
    FRACTIONS,
    SHARES,
    STEPS,
    SVM_STEP_FACTOR,
)
from query_catalog.inputs import (
    ALPHA_DRAWS,
    LINEITEM_INTERCEPT,
    LINEITEM_WEIGHTS,
    REFERENCE_INTERCEPT,
    REG,
    WIDTH,
)

ORACLES: dict[str, str] = {}

# The public 64-bit xxHash primes and the outer hash seed.
P1 = 11400714785074694791
P2 = 14029467366897019727
P3 = 1609587929392839161
P4 = 9650029242287828579
P5 = 2870177450012600261
OUTER_SEED = 42
MODULUS = "18446744073709551616::UHUGEINT"


def let(value: str, body: str) -> str:
    """``body`` over the variable h, bound to ``value``."""
    return f"list_transform([{value}], lambda h: {body})[1]"


def _wrap(expression: str) -> str:
    return f"(({expression}) % {MODULUS})"


def _times(a: str, prime: int) -> str:
    return _wrap(f"{a} * {prime}::UHUGEINT")


def _rotl(bits: int) -> str:
    return _wrap(f"(h << {bits}) | (h >> {64 - bits})")


def _hash_long(value: str, seed: str) -> str:
    word = _times(let(_times(value, P2), _rotl(31)), P1)
    mixed = f"xor({_wrap(f'{seed} + {(P5 + 8) % 2**64}::UHUGEINT')}, {word})"
    h = _wrap(f"{_times(let(mixed, _rotl(27)), P1)} + {P4}::UHUGEINT")
    h = let(h, _times("xor(h, h >> 33)", P2))
    h = let(h, _times("xor(h, h >> 29)", P3))
    return let(h, "xor(h, h >> 32)")


def uniform(key: str, seed: str | int) -> str:
    """Uniform [0, 1) of a non-negative key and seed."""
    inner = _hash_long(f"({key})::UHUGEINT", f"{OUTER_SEED}::UHUGEINT")
    outer = _hash_long(f"({seed})::UHUGEINT", inner)
    return f"(({outer} >> 11)::UBIGINT::DOUBLE * {2.0**-53!r})"


def normal(key: str, seed: str | int) -> str:
    first, second = uniform(f"2*({key})", seed), uniform(f"2*({key})+1", seed)
    return f"(sqrt(-2.0 * ln(1.0 - {first})) * cos(2.0 * pi() * {second}))"


def r(expression: str, digits: int = 6) -> str:
    """Rounded, with no negative zero."""
    return f"(CASE WHEN round({expression}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({expression}, {digits}) END)"


def vector(values) -> str:
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"


REFERENCE = f"[sin(j) FOR j IN range(1, {WIDTH + 1})]"

PTS = """pts AS (
  SELECT vec_id AS id, CASE WHEN label < 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
         CASE WHEN label < 5 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y,
         embedding::DOUBLE[] AS x
  FROM embeddings)"""

LINES = """pts AS (
  SELECT (l_orderkey * 16 + l_linenumber) * 4096 + row_number() OVER (
           PARTITION BY l_orderkey, l_linenumber
           ORDER BY l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag) AS id, CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
         CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y,
         [l_quantity, l_extendedprice, l_discount, l_tax] AS x
  FROM lineitem)"""


def narrow(axes: int) -> str:
    mapped = [f"list_dot_product(x, [CASE WHEN (j - 1) % {axes} = {a} THEN sin(j) ELSE 0.0 END "
              f"FOR j IN range(1, {WIDTH + 1})])" for a in range(axes)]
    return f"full_points AS (SELECT * FROM ({PTS[len('pts AS ('):-1]})), " \
           f"pts AS (SELECT id, label, y, [{', '.join(mapped)}] AS x FROM full_points)"


def cells(source: str, *keep: str, column: str = "x") -> str:
    names = "".join(f"{k}, " for k in keep)
    return (f"SELECT {names}(d - 1)::INTEGER AS dim, {r(f'{column}[d]')} AS value "
            f"FROM (SELECT *, unnest(range(1, len({column}) + 1)) AS d FROM {source})")


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def add(name: str, sql: str) -> None:
    ORACLES[name] = sql


# Sources and sinks

TEXT_LINE = ("(CASE WHEN label = 1 THEN '1.0' ELSE '0.0' END) || ' ' || "
             "array_to_string(list_transform(x, lambda v: printf('%.4f', v)), ' ')")
add("write_labeled_text", f"WITH {PTS} SELECT {TEXT_LINE} AS value FROM pts")
add("read_labeled_text",
    f"WITH {PTS}, t AS (SELECT label, list_transform(x, lambda v: printf('%.4f', v)::DOUBLE) AS x "
    f"FROM pts) {cells('t', 'label')}")

INDEXED = ("indexed AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS idx, "
           "count(*) OVER () AS n FROM {source})")


def drawn(source: str, iterations: int) -> str:
    return (INDEXED.format(source=source) + f""", drawn AS (
      SELECT i AS iter, floor({uniform('i', '42 + i')} * (SELECT count(*) FROM {source}))::BIGINT AS idx
      FROM (SELECT unnest(range(1, {iterations + 1})) AS i))""")


ALPHAS = drawn("pts", ALPHA_DRAWS) + """, alphas AS (
  SELECT id, count(*)::DOUBLE AS alpha FROM drawn JOIN indexed USING (idx) GROUP BY id)"""
SUPPORT = f"{PTS}, {ALPHAS}, support AS (SELECT id, y, alpha, x FROM pts JOIN alphas USING (id))"
add("support_vectors", f"WITH {SUPPORT} {cells('support', 'id', 'y', 'alpha')}")
add("support_write", f"WITH {SUPPORT} {cells('support', 'y')}")

add("sweep_read", """
SELECT 'embeddings' AS dimension, label::DOUBLE AS value, count(*)::DOUBLE AS seconds
FROM embeddings GROUP BY label
UNION ALL SELECT 'labels', quality::DOUBLE, count(*)::DOUBLE FROM labels GROUP BY quality
UNION ALL SELECT 'lineitem', l_linenumber::DOUBLE, count(*)::DOUBLE FROM lineitem GROUP BY l_linenumber
""")

# Projections, predicates, checks

add("label_to_sign", f"WITH {PTS} SELECT id, y FROM pts")
add("append_bias", f"WITH {PTS}, t AS (SELECT id, list_append(x, 1.0::DOUBLE) AS x FROM pts) "
                   f"{cells('t', 'id')}")
add("split_bias", f"WITH {PTS}, t AS (SELECT id, x[1:-2] AS x, {r('x[-1]')} AS intercept FROM pts) "
                  f"{cells('t', 'id', 'intercept')}")
add("margin_violations",
    f"WITH {PTS}, t AS (SELECT id, y * {dot('x', REFERENCE)} AS margin FROM pts) "
    f"SELECT id, {r('margin')} AS margin FROM t WHERE margin < 1")
add("label_check", " UNION ALL ".join(
    f"SELECT '{t}.{c}' AS source, count(*) AS n_rows, "
    f"count(*) FILTER (WHERE {c} NOT IN (0, 1) OR {c} IS NULL) AS bad_labels FROM {t}"
    for t, c in (("labels", "quality"), ("labels", "toxic"), ("embeddings", "label"),
                 ("lineitem", "l_linenumber"))))
for _name, _source in (("preflight", PTS), ("preflight_lineitem", LINES)):
    add(_name, f"WITH {_source} SELECT count(*) AS n_rows, min(len(x))::INTEGER AS min_width, "
               f"max(len(x))::INTEGER AS max_width, "
               f"count(*) FILTER (WHERE label NOT IN (0, 1)) AS bad_labels FROM pts")

# Sampling

add("minibatch", f"SELECT o_orderkey AS id FROM orders WHERE {uniform('o_orderkey', 43)} < 0.1")
add("landmarks", f"SELECT o_orderkey AS id FROM orders ORDER BY {uniform('o_orderkey', 5)}, id LIMIT 30")
ORDER_IDS = "ids AS (SELECT o_orderkey AS id FROM orders)"
add("row_index", f"WITH {ORDER_IDS}, {INDEXED.format(source='ids')} SELECT id, idx FROM indexed")
add("draws", f"WITH {ORDER_IDS}, {drawn('ids', ALPHA_DRAWS)} "
             "SELECT iter::INTEGER AS iter, idx, id FROM drawn JOIN indexed USING (idx)")
add("train_test_split",
    f"WITH {ORDER_IDS} SELECT id, CASE WHEN {uniform('id', 11)} < 0.6 THEN 'train' ELSE 'test' END "
    "AS part FROM ids")

# Aggregates and update rules


def gradient(source: str, weights: str, intercept: float | None, where: str = "true",
             digits: int = 6) -> str:
    bias = 0.0 if intercept is None else intercept
    features = "x" if intercept is None else "list_append(x, 1.0::DOUBLE)"
    return f"""WITH {source}, t AS (
      SELECT y, {features} AS x, y * ({dot('x', weights)} + {bias!r}::DOUBLE) AS m FROM pts WHERE {where}),
    e AS (SELECT y, m, x[d] AS v, d FROM (SELECT *, unnest(range(1, len(x) + 1)) AS d FROM t)),
    s AS (SELECT sum(greatest(0.0, 1.0 - m)) AS loss_sum, count(*) AS batch_rows FROM t)
    SELECT (d - 1)::INTEGER AS dim, {r('gradient', digits)} AS gradient, {r('loss_sum', digits)} AS loss_sum,
           batch_rows
    FROM (SELECT d, sum(CASE WHEN m < 1 THEN -y * v ELSE 0.0 END) AS gradient FROM e GROUP BY d), s"""


add("hinge_gradient", gradient(PTS, REFERENCE, REFERENCE_INTERCEPT))
add("hinge_gradient_batch", gradient(PTS, REFERENCE, None, f"{uniform('id', 43)} < 0.1"))
add("hinge_gradient_lineitem",
    gradient(LINES, vector(LINEITEM_WEIGHTS), LINEITEM_INTERCEPT, digits=3))


def one_step(rate: float) -> str:
    return f"""WITH {PTS}, t AS (SELECT y, x, y * {dot('x', REFERENCE)} AS m FROM pts),
    e AS (SELECT y, m, x[d] AS v, d FROM (SELECT *, unnest(range(1, len(x) + 1)) AS d FROM t))
    SELECT (d - 1)::INTEGER AS dim, {r('w')} AS value FROM (
      SELECT d, sin(d) * {1.0 - rate * REG!r}::DOUBLE
        - {rate!r}::DOUBLE * avg(CASE WHEN m < 1 THEN -y * v ELSE 0.0 END) AS w FROM e GROUP BY d)"""


add("pegasos_step", one_step(1.0 / (3 * REG)))
add("sqrt_step", one_step(1.0 / math.sqrt(3)))


def squared_distance(a: str, b: str) -> str:
    return f"power(list_distance({a}, {b}), 2)"


def gaussian(a: str, b: str) -> str:
    return f"exp(-0.5 * {squared_distance(a, b)})"


def landmark_table(size: int, seed: int) -> str:
    return (f"lm AS (SELECT id, x, row_number() OVER (ORDER BY id) AS pos FROM "
            f"(SELECT id, x FROM pts ORDER BY {uniform('id', seed)}, id LIMIT {size}))")


add("kernel_score", f"""WITH {PTS}, {ALPHAS}, {landmark_table(10, 5)}
SELECT id, {r('score')} AS score FROM (
  SELECT t.id, sum(CASE WHEN p.id = t.id THEN 0.0 ELSE p.y * a.alpha * {gaussian('p.x', 't.x')} END) AS score
  FROM lm t, pts p JOIN alphas a USING (id) GROUP BY t.id)""")
add("gram", f"""WITH {PTS}, {landmark_table(30, 5)}
SELECT a.id, (b.pos - 1)::INTEGER AS dim, {r(gaussian('a.x', 'b.x'))} AS value FROM lm a, lm b""")


def objective(source: str, weights: str, intercept: float) -> str:
    margin = f"y * ({dot('x', weights)} + {intercept!r}::DOUBLE)"
    value = f"avg(greatest(0.0, 1.0 - {margin})) + {0.5 * REG!r} * {dot(weights, weights)}"
    return f"WITH {source} SELECT {r('v')} AS objective FROM (SELECT {value} AS v FROM pts)"


add("objective", objective(PTS, REFERENCE, 0.0))
add("objective_lineitem", objective(LINES, vector(LINEITEM_WEIGHTS), LINEITEM_INTERCEPT))

UNPIVOT = ("e AS (SELECT id, label, y, x[d] AS v, d FROM "
           "(SELECT *, unnest(range(1, len(x) + 1)) AS d FROM pts))")
add("scale_features", f"""WITH {PTS}, {UNPIVOT},
s AS (SELECT d, stddev_samp(v) AS sd FROM e GROUP BY d)
SELECT id, (d - 1)::INTEGER AS dim, {r('v / sd')} AS value FROM e JOIN s USING (d)""")


def auroc(source: str, score: str) -> str:
    return f"""WITH {source}, t AS (SELECT label, {score} AS score FROM pts),
    k AS (SELECT label, rank() OVER (ORDER BY score)
            + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM t),
    c AS (SELECT sum(label) AS p, sum(1 - label) AS n, sum(label * rk) AS s FROM k)
    SELECT {r('(s - p * (p + 1) / 2) / (p * n)')} AS auroc FROM c"""


add("auroc", auroc(PTS, f"{dot('x', REFERENCE)} + {REFERENCE_INTERCEPT!r}"))
add("auroc_ties", auroc(LINES, "x[3]"))

# Trainers


def descent(points: str, settings: list[tuple], iterations: int, *, bias: float | None = None,
            start: str | None = None, penalty_after: bool = False, width: int = WIDTH,
            rule: str, scale: bool = False) -> str:
    """CTEs ending in ``st(s, i, w, pen, loss, n)``, one row per setting and iteration.

    A setting is ``(step, fraction, share)``. ``bias`` is the first value of a
    regularised bias, the last entry of w.
    """
    length = width + (bias is not None)
    first = start or f"[0.0::DOUBLE FOR j IN range(1, {width + 1})]"
    if bias is not None:
        first = f"list_append({first}, {bias!r}::DOUBLE)"
    rate = {"pegasos": f"(step / (i * {REG!r}))", "sqrt": "(step / sqrt(i))"}[rule]
    features = "x"
    scaling = ""
    if scale:
        scaling = f"""{UNPIVOT}, dev AS (
          SELECT list(sd ORDER BY d) AS sds FROM (SELECT d, stddev_samp(v) AS sd FROM e GROUP BY d)),"""
        features = f"[x[d] / sds[d] FOR d IN range(1, {width + 1})]"
    if bias is not None:
        features = f"list_append({features}, 1.0::DOUBLE)"
    rows = ", ".join(f"({s}, {step!r}::DOUBLE, {f!r}::DOUBLE, {share!r}::DOUBLE)"
                     for s, (step, f, share) in enumerate(settings))
    sampled = any(f < 1 for _, f, _ in settings)
    shared = any(sh < 1 for *_, sh in settings)
    u = uniform("id", "42 + it") if sampled else "0.0"
    u0 = uniform("id", 0) if shared else "0.0"
    seen_penalty = "pen_new" if penalty_after else "pen"
    zeros = f"[0.0::DOUBLE FOR j IN range(1, {length + 1})]"
    return f"""{points}, {scaling}
    data AS (SELECT id, y, {features} AS x, {u0} AS u0 FROM pts{', dev' if scale else ''}),
    batches AS (SELECT it, y, x, u0, {u} AS u FROM data, (SELECT unnest(range(1, {iterations + 1})) AS it)),
    settings(s, step, fraction, share) AS (VALUES {rows}),
    st(s, i, w, pen, loss, n) AS (
      SELECT s, 0::BIGINT, {first}, {0.5 * REG!r} * list_dot_product({first}, {first}), 0.0::DOUBLE, 0::BIGINT
      FROM settings
      UNION ALL
      SELECT s, i, w_new, {0.5 * REG!r} * list_dot_product(w_new, w_new),
             loss_mean + CASE WHEN '{seen_penalty}' = 'pen' THEN pen
                              ELSE {0.5 * REG!r} * list_dot_product(w_new, w_new) END, n
      FROM (
        SELECT s, i, pen, n, loss_mean, CASE WHEN n = 0 THEN w ELSE
          [w[d] * (1.0 - {rate} * {REG!r})
           - {rate} * list_sum(list_transform(gs, lambda g: g[d])) / n
           FOR d IN range(1, {length + 1})] END AS w_new
        FROM (
          SELECT q.s, q.i + 1 AS i, q.step, q.w, q.pen, a.n, a.loss_mean, a.gs
          FROM (SELECT st.*, step, fraction, share FROM st JOIN settings USING (s)
                WHERE st.i < {iterations}) q,
          LATERAL (
            SELECT count(*) AS n, avg(greatest(0.0, 1.0 - m)) AS loss_mean,
                   list(CASE WHEN m < 1 THEN list_transform(x, lambda v: -y * v) ELSE {zeros} END) AS gs
            FROM (SELECT y, x, y * list_dot_product(x, q.w) AS m FROM batches
                  WHERE it = q.i + 1 AND u < q.fraction AND u0 < q.share)) a)))"""


def trained(points: str, setting: tuple, iterations: int, **options) -> str:
    width = options.get("width", WIDTH)
    bias = options.get("bias")
    scale = options.get("scale", False)
    weight = "w[d] / sds[d]" if scale else "w[d]"
    source = "last_w, dev" if scale else "last_w"
    intercept = f"w[{width + 1}]" if bias is not None else "0.0::DOUBLE"
    return f"""WITH RECURSIVE {descent(points, [setting], iterations, **options)},
    last_w AS (SELECT w FROM st ORDER BY i DESC LIMIT 1)
    SELECT 'loss' AS part, i::INTEGER AS pos, {r('loss')} AS value FROM st WHERE n > 0
    UNION ALL SELECT 'weight', (d - 1)::INTEGER, {r(weight)}
      FROM (SELECT *, unnest(range(1, {width + 1})) AS d FROM {source})
    UNION ALL SELECT 'intercept', 0::INTEGER, {r(intercept)} FROM last_w"""


PLAIN = dict(rule="pegasos", penalty_after=True)
add("train_linear_pegasos", trained(PTS, (1.0, 1.0, 1.0), 5, bias=0.0, **PLAIN))
add("train_linear_pegasos_batch", trained(PTS, (1.0, 0.1, 1.0), 12, **PLAIN))
SCALED_LINES = LINES.replace("pts AS", "raw_points AS", 1) + """, dv AS (
  SELECT list(sd ORDER BY d) AS ds FROM (SELECT d, stddev_samp(x[d]) AS sd
    FROM (SELECT x, unnest(range(1, 5)) AS d FROM raw_points) GROUP BY d)),
  pts AS (SELECT id, label, y, [x[d] / ds[d] FOR d IN range(1, 5)] AS x FROM raw_points, dv)"""
add("train_linear_pegasos_lineitem",
    trained(SCALED_LINES, (1.0, 1.0, 1.0), 5, bias=0.0, width=4, **PLAIN))
add("train_pegasos", trained(PTS, (2.0, 0.5, 1.0), 6, rule="pegasos"))
add("train_svm_sgd", trained(PTS, (3.0, 1.0, 1.0), 6, rule="sqrt"))
add("train_warm_start", trained(PTS, (1.0, 1.0, 1.0), 5, rule="sqrt", start=REFERENCE))
add("train_with_intercept", trained(PTS, (2.0, 1.0, 1.0), 5, rule="sqrt", bias=1.0))
add("train_scaled", trained(PTS, (1.0, 1.0, 1.0), 5, rule="sqrt", bias=1.0, scale=True))

add("train_linear_pegasos_small_batch",
    trained(PTS, (1.0, 0.02, 1.0), 12, **PLAIN))
add("train_defaults", trained(PTS, (1.0, 1.0, 1.0), 100, bias=0.0, **PLAIN))

RFF = 40


def rff_points(seed: int) -> str:
    return f"""{PTS.replace('pts AS', 'raw_points AS', 1)},
    rw AS (SELECT list({normal('j', seed)} ORDER BY j) AS w
           FROM (SELECT unnest(range(0, {WIDTH * RFF})) AS j)),
    columns AS (SELECT [[w[(j - 1) * {RFF} + k] FOR j IN range(1, {WIDTH + 1})]
                        FOR k IN range(1, {RFF + 1})] AS w FROM rw),
    rb AS (SELECT list(2.0 * pi() * {uniform('j', seed + 1)} ORDER BY j) AS b
           FROM (SELECT unnest(range(0, {RFF})) AS j)),
    pts AS (SELECT id, label, y, [sqrt(2.0 / {RFF}) * cos(list_dot_product(x, w[k]) + b[k])
                                  FOR k IN range(1, {RFF + 1})] AS x
            FROM raw_points, columns, rb)"""


add("rff_transform", f"WITH {rff_points(7)} {cells('pts', 'id')}")
add("train_rff", trained(rff_points(7), (1.0, 1.0, 1.0), 5, width=RFF, **PLAIN))
add("train_own_map", trained(rff_points(7), (2.0, 1.0, 1.0), 5, width=RFF, rule="pegasos"))

LANDMARKS = 30


def inverse_root(seed: int) -> str:
    """CTE ``inv(n)``: the inverse square root of the landmark Gram matrix, by the
    coupled Newton-Schulz iteration."""
    size = f"range(1, {LANDMARKS + 1})"

    def product(a: str, b: str) -> str:
        column = f"[{b}[k][j] FOR k IN {size}]"
        return f"[[list_dot_product({a}[i], {column}) FOR j IN {size}] FOR i IN {size}]"

    return f"""{landmark_table(LANDMARKS, seed)},
    km AS (SELECT list(row_values ORDER BY pos) AS k FROM (
      SELECT a.pos, list({gaussian('a.x', 'b.x')} ORDER BY b.pos) AS row_values FROM lm a, lm b GROUP BY a.pos)),
    ns(step, c, ym, zm) AS (
      SELECT 0, {LANDMARKS}.0::DOUBLE,
        [[k[i][j] / {LANDMARKS}.0 FOR j IN {size}] FOR i IN {size}],
        [[(CASE WHEN i = j THEN 1.0 ELSE 0.0 END)::DOUBLE FOR j IN {size}] FOR i IN {size}] FROM km
      UNION ALL
      SELECT step + 1, c,
        {product('ym', 't')},
        {product('t', 'zm')}
      FROM (SELECT step, c, ym, zm,
              [[(CASE WHEN i = j THEN 1.5 ELSE 0.0 END)::DOUBLE - 0.5 * zy[i][j]
                FOR j IN {size}] FOR i IN {size}] AS t
            FROM (SELECT *, {product('zm', 'ym')} AS zy FROM ns WHERE step < 20))),
    inv AS (SELECT [[v / sqrt(c) FOR v IN row_values] FOR row_values IN zm] AS n FROM ns
            ORDER BY step DESC LIMIT 1)"""


def nystrom_points(seed: int) -> str:
    size = f"range(1, {LANDMARKS + 1})"
    inner = inverse_root(seed).replace("FROM pts", "FROM raw_points")
    return f"""{PTS.replace('pts AS', 'raw_points AS', 1)}, {inner},
    kx AS (SELECT p.id, p.label, p.y, list({gaussian('p.x', 'l.x')} ORDER BY l.pos) AS k
           FROM raw_points p, lm l GROUP BY p.id, p.label, p.y),
    pts AS (SELECT id, label, y, [list_dot_product(k, n[j]) FOR j IN {size}] AS x FROM kx, inv)"""


add("nystrom_fit", f"WITH RECURSIVE {PTS}, {inverse_root(5)}, "
                   f"t AS (SELECT (i - 1)::INTEGER AS pos, n[i] AS x FROM "
                   f"(SELECT n, unnest(range(1, {LANDMARKS + 1})) AS i FROM inv)) {cells('t', 'pos')}")
add("nystrom_transform", f"WITH RECURSIVE {nystrom_points(5)} {cells('pts', 'id')}")
add("train_nystrom", trained(nystrom_points(5), (1.0, 1.0, 1.0), 5, width=LANDMARKS, **PLAIN))

KERNEL_TRAINING = f"""{PTS.replace('pts AS', 'raw_points AS', 1)},
  pts AS (SELECT id, label, y, list_append(x, 1.0::DOUBLE) AS x FROM raw_points),
  {drawn('pts', ALPHA_DRAWS)},
  rows_drawn AS (SELECT iter, idx, y, x FROM drawn JOIN indexed USING (idx)),
  st(i, a) AS (
    SELECT 0::BIGINT, [0.0::DOUBLE FOR j IN range(0, (SELECT count(*) FROM pts))]
    UNION ALL
    SELECT i, [a[k] + CASE WHEN k = idx + 1 AND score < 1 THEN 1.0 ELSE 0.0 END
               FOR k IN range(1, len(a) + 1)]
    FROM (
      SELECT q.i + 1 AS i, q.a, q.idx, q.y * e.total / ({REG!r} * (q.i + 1)) AS score
      FROM (SELECT st.i, st.a, d.idx, d.y, d.x FROM st JOIN rows_drawn d ON d.iter = st.i + 1) q,
      LATERAL (SELECT sum(CASE WHEN p.idx = q.idx OR q.a[p.idx + 1] = 0 THEN 0.0
                          ELSE p.y * q.a[p.idx + 1] * {gaussian('p.x', 'q.x')} END) AS total
               FROM indexed p) e)),
  final_a AS (SELECT a FROM st ORDER BY i DESC LIMIT 1),
  support AS (SELECT id, y, x, a[idx + 1] AS alpha FROM indexed, final_a WHERE a[idx + 1] > 0)"""
add("train_kernel_pegasos", f"WITH RECURSIVE {KERNEL_TRAINING} SELECT id, y, alpha FROM support")
add("predict_kernel", f"""WITH RECURSIVE {KERNEL_TRAINING}
SELECT id, {r('score')} AS score FROM (
  SELECT p.id, sum(s.alpha * s.y * {gaussian('s.x', 'p.x')}) / {REG * ALPHA_DRAWS!r} AS score
  FROM pts p, support s GROUP BY p.id)""")


def sweep(trainer: str, dimension: str, values: list[tuple[float, tuple]], iterations: int,
          rule: str) -> str:
    names = ", ".join(f"({s}, {v!r}::DOUBLE)" for s, (v, _) in enumerate(values))
    return f"""(WITH RECURSIVE {descent(PTS, [t for _, t in values], iterations, rule=rule)},
    names(s, value) AS (VALUES {names})
    SELECT '{trainer}' AS trainer, '{dimension}' AS dimension, value, i::INTEGER AS iter, {r('loss')} AS loss
    FROM st JOIN names USING (s) WHERE n > 0)"""


add("sweep_step",
    "SELECT * FROM " + sweep("pegasos", "step", [(s, (s, 0.1, 1.0)) for s in STEPS], 6, "pegasos")
    + " UNION ALL SELECT * FROM "
    + sweep("svm", "step", [(s, (s * SVM_STEP_FACTOR, 0.1, 1.0)) for s in STEPS], 6, "sqrt"))
add("sweep_batch", "SELECT * FROM " + sweep(
    "pegasos", "batch", [(f, (1.0, f, 1.0)) for f in FRACTIONS], 5, "pegasos"))
add("sweep_size", "SELECT * FROM " + sweep(
    "svm", "size", [(s, (2.0, 1.0, s)) for s in SHARES], 5, "sqrt"))

TRACES = f"""WITH RECURSIVE {descent(
    PTS, [(s, 1.0, 1.0) for s in (1.0, 3.0, 5.0)], 34, rule='pegasos')},
  trace AS (SELECT 'step' AS dimension, (step::INTEGER)::VARCHAR AS setting, 'pegasos' AS trainer,
                   i::INTEGER AS iter, i * 10 AS elapsed_ms, loss
            FROM st JOIN settings USING (s) WHERE n > 0)"""
TRACE_ROWS = f"SELECT dimension, setting, trainer, iter, elapsed_ms, {r('loss')} AS loss FROM trace"
add("trace_read", f"{TRACES} {TRACE_ROWS}")
add("trace_tail", f"{TRACES} {TRACE_ROWS} WHERE iter > 30")
add("trace_write", f"""{TRACES}
SELECT elapsed_ms::VARCHAR AS first_word, {r('loss')} AS loss FROM trace
UNION ALL SELECT w, NULL::DOUBLE FROM (SELECT unnest(['3', '###']) AS w), settings""")
add("trace_summary", f"""{TRACES}
SELECT dimension, trainer, setting, count(*) AS iterations, {r('arg_max(loss, iter)')} AS last_loss,
       {r('min(loss)')} AS least_loss, max(elapsed_ms) AS total_ms
FROM trace GROUP BY dimension, trainer, setting""")

# Kernels and prediction

for _name, _value in (
    ("kernel_linear", dot("a.x", "b.x")),
    ("kernel_gaussian", gaussian("a.x", "b.x")),
    ("kernel_polynomial", f"power({dot('a.x', 'b.x')} + 1, 2)"),
):
    add(_name, f"""WITH {PTS}, ix AS (SELECT id, x, row_number() OVER (ORDER BY id) - 1 AS idx FROM pts)
    SELECT a.id, {r(_value)} AS value FROM ix a, ix b
    WHERE b.idx = (a.idx + 1) % (SELECT count(*) FROM pts)""")

SCORE = f"{dot('x', REFERENCE)} + {REFERENCE_INTERCEPT!r}"
add("predict_linear", f"WITH {PTS} SELECT id, {r(SCORE)} AS score FROM pts")
add("predict_label", f"WITH {PTS} SELECT id, CASE WHEN {SCORE} > 0.1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END "
                     "AS prediction FROM pts")
add("predict_label_lineitem", f"""WITH {LINES}, t AS (
  SELECT label, CASE WHEN {dot('x', vector(LINEITEM_WEIGHTS))} + {LINEITEM_INTERCEPT!r} > 0
                     THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction FROM pts)
SELECT label, prediction, count(*) AS n_rows FROM t GROUP BY label, prediction""")


def narrow_model(axes: int) -> str:
    return (descent(narrow(axes), [(1.0, 1.0, 1.0)], 5, bias=0.0, width=axes, **PLAIN)
            + ", model AS (SELECT w FROM st ORDER BY i DESC LIMIT 1)")


SURFACE_2D = f"""WITH RECURSIVE {narrow_model(2)}, grid AS (
  SELECT i * 0.02::DOUBLE - 2.0::DOUBLE AS x, j * 0.02::DOUBLE - 2.0::DOUBLE AS y
  FROM (SELECT unnest(range(0, 201)) AS i), (SELECT unnest(range(0, 201)) AS j)),
surface AS (SELECT x, y, x * w[1] + y * w[2] + w[3] AS z FROM grid, model)"""
add("surface_2d", f"{SURFACE_2D} SELECT {r('x')} AS x, {r('y')} AS y, {r('z')} AS z FROM surface")
add("surface_write", f"{SURFACE_2D} SELECT printf('%f %f %f', x, y, z) AS value FROM surface")
add("surface_3d", f"""WITH RECURSIVE {narrow_model(3)}, axis AS (
  SELECT unnest(range(0, 101)) * 0.05::DOUBLE - 2.5::DOUBLE AS v),
scored AS (SELECT a.v AS x, b.v AS y, c.v AS z,
                  abs(a.v * w[1] + b.v * w[2] + c.v * w[3] + w[4]) AS s FROM axis a, axis b, axis c, model)
SELECT {r('x')} AS x, {r('y')} AS y, {r('arg_min(z, (s, z))')} AS z FROM scored GROUP BY x, y""")

# Generated data

ORDER_COUNT = "n AS (SELECT count(*) AS n FROM orders), k AS (SELECT unnest(range(0, n)) AS k, n FROM n)"
add("gen_linear", f"""WITH {ORDER_COUNT}
SELECT k AS id, (1 - k % 2)::DOUBLE AS label, d::INTEGER AS dim,
       {r(normal('k * 8 + d', 3) + ' + (CASE WHEN k % 2 = 0 THEN 1.0 ELSE -1.0 END)')} AS value
FROM (SELECT k, unnest(range(0, 8)) AS d FROM k)""")


def shape(label: str, used: str, axes: list[str], extra: str = "") -> str:
    rows = ", ".join(f"({a})::DOUBLE" for a in axes)
    return f"""WITH {ORDER_COUNT}, m AS (SELECT k AS id, k, n FROM k WHERE k < {used}),
    made AS (SELECT id, (CASE WHEN {label} THEN 1.0 ELSE 0.0 END)::DOUBLE AS label, [{rows}] AS x FROM m)
    {extra or cells('made', 'id', 'label')}"""


def g(stream: int) -> str:
    return normal("k", 48 + stream)


def u(stream: int) -> str:
    return uniform("k", 48 + stream)


HALF = "((n + 1) // 2)"
FIRST = f"k < {HALF}"


def either(a: str, b: str) -> str:
    return f"CASE WHEN {FIRST} THEN {a} ELSE {b} END"


for _axes in (2, 3):
    add(f"gen_shape_linear_{_axes}d", shape(FIRST, "n", [
        f"{g(a)} + {either('1.0', '-1.0')}" for a in range(_axes)]))
add("gen_shape_circle_2d", shape(FIRST, "n", [
    either(f"0.3 * {g(a)}", f"{f}({g(3)} * 2 * pi()) * ({u(2)} * 0.5 + 1.0)")
    for a, f in enumerate(("cos", "sin"))]))
add("gen_shape_mixture_2d", shape("k * 3 // n <> 1", "n", [
    f"0.5 * {g(a)} + CASE k * 3 // n WHEN 0 THEN {c[0]} WHEN 1 THEN {c[1]} ELSE {c[2]} END"
    for a, c in enumerate((("0.3", "-0.3", "-1.0"), ("0.5", "-0.5", "-1.0")))]))
CELL = "(k * 16 // n)"
add("gen_shape_checkers_2d", shape(
    f"({CELL} // 4 + {CELL} % 4) % 2 = 1", "n",
    [f"{CELL} // 4 - 2 + {u(0)}", f"{CELL} % 4 - 2 + {u(1)}"]))
X = f"({u(2)} * 6.0 - 3.0)"
add("gen_shape_clowns_2d", shape(FIRST, "n", [
    either(X, f"0.8 * {g(0)}"), either(f"{X} * {X} + {g(3)}", f"0.8 * {g(1)} + 6.0")],
    f""", s AS (SELECT avg(x[1]) AS m1, stddev_pop(x[1]) AS s1, avg(x[2]) AS m2, stddev_pop(x[2]) AS s2 FROM made),
    moved AS (SELECT id, label, [(x[1] - m1) / s1, (x[2] - m2) / s2] AS x FROM made, s)
    {cells('moved', 'id', 'label')}"""))
SIDE = "greatest(1, floor(sqrt(n // 2))::BIGINT)"


def _grid(step: str) -> str:
    return f"({step} * (3.0::DOUBLE / greatest(1, {SIDE} - 1)) - 1.5)"


BX, BY = _grid(f"((k - {HALF}) % {SIDE})"), _grid(f"((k - {HALF}) // {SIDE} % {SIDE})")
BALL = shape(FIRST, "n", [
    either(f"0.4 * {g(0)}", BX), either(f"0.4 * {g(1)}", BY),
    either(f"0.4 * {g(2)}", f"2.25 - {BX} * {BX} - {BY} * {BY}")])
add("gen_shape_ball_3d", BALL)
BALL_POINTS = (BALL[BALL.index("WITH ") + 5:].rsplit("SELECT", 2)[0].rstrip()
               + ", pts AS (SELECT id, label, label * 2 - 1 AS y, x FROM made)")
add("surface_3d_kernel", f"""WITH {BALL_POINTS}, {landmark_table(12, 5)}, axis AS (
  SELECT unnest(range(0, 101)) * 0.05::DOUBLE - 2.5::DOUBLE AS v),
scored AS (SELECT a.v AS x, b.v AS y, c.v AS z,
    abs(sum(l.y * {gaussian('l.x', '[a.v, b.v, c.v]')})) AS s
  FROM axis a, axis b, axis c, (SELECT lm.id, y, lm.x FROM lm JOIN pts USING (id)) l GROUP BY a.v, b.v, c.v)
SELECT {r('x')} AS x, {r('y')} AS y, {r('arg_min(z, (s, z))')} AS z FROM scored GROUP BY x, y""")
add("kernel_gaussian_lineitem", f"""WITH {LINES.replace('pts AS', 'raw_points AS', 1)},
pts AS (SELECT id, label, y, [v / 50.0 FOR v IN x] AS x FROM raw_points), {landmark_table(5, 5)}
SELECT p.id, (row_number() OVER (PARTITION BY p.id ORDER BY l.id) - 1)::INTEGER AS dim,
       {r(gaussian('p.x', 'l.x'))} AS value FROM pts p, lm l""")
add("minibatch_lineitem", f"WITH {LINES} SELECT id, label FROM pts WHERE {uniform('id', 45)} < 0.1")
add("predict_one", f"""WITH {PTS}, m AS (SELECT list(v ORDER BY d) AS x FROM (
  SELECT d, avg(x[d]) AS v FROM (SELECT x, unnest(range(1, {WIDTH + 1})) AS d FROM pts) GROUP BY d))
SELECT {r(SCORE)} AS score, CASE WHEN {SCORE} > 0.1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction FROM m""")
add("own_validators", f"""WITH {PTS}
SELECT 'width' AS name, (count_if(len(x) <> {WIDTH}) = 0)::INTEGER AS accepted FROM pts
UNION ALL SELECT 'unit_length', (count_if(abs(list_dot_product(x, x) - 1) > 1e-3) = 0)::INTEGER FROM pts
UNION ALL SELECT 'positive', (count_if(list_min(x) < 0) = 0)::INTEGER FROM pts""")
add("train_own_rule", f"""WITH RECURSIVE {PTS}, st(i, w, loss) AS (
  SELECT 0::BIGINT, [0.0::DOUBLE FOR j IN range(1, {WIDTH + 1})], 0.0::DOUBLE
  UNION ALL
  SELECT q.i + 1, [q.w[d] - 2.0 * power(0.5, q.i + 1) * list_sum(list_transform(a.gs, lambda g: g[d])) / a.n
                   FOR d IN range(1, {WIDTH + 1})], a.loss
  FROM (SELECT * FROM st WHERE i < 5) q, LATERAL (
    SELECT count(*) AS n, avg(abs(gap)) AS loss, list(list_transform(x, lambda v: sign(gap) * v)) AS gs
    FROM (SELECT x, list_dot_product(x, q.w) - y AS gap FROM pts)) a),
last_w AS (SELECT w FROM st ORDER BY i DESC LIMIT 1)
SELECT 'loss' AS part, i::INTEGER AS pos, {r('loss')} AS value FROM st WHERE i > 0
UNION ALL SELECT 'weight', (d - 1)::INTEGER, {r('w[d]')} FROM (SELECT *, unnest(range(1, {WIDTH + 1})) AS d FROM last_w)
UNION ALL SELECT 'intercept', 0::INTEGER, 0.0::DOUBLE""")
