"""The registered queries as DuckDB SQL over the same tables.

``VIEWS`` restates the tables of ``fixtures`` in SQL; every query is a SELECT over them.
"""

from __future__ import annotations

from masteria.functions.fixed import WHITE_SPACE

_SPACE = "".join(f"\\x{{{ord(c):x}}}" for c in WHITE_SPACE)
# The benchmarks that come first in the grid. The lists of families and benchmarks further
# down are fixed values too; see ``functions.fixed``.
_PLACE = ("CASE {0} WHEN 'MATH' THEN 1 WHEN 'BBH' THEN 2 WHEN 'GPQA' THEN 3 "
          "WHEN 'IFEval' THEN 4 WHEN 'MuSR' THEN 5 ELSE 6 END")


def _normalized(text: str) -> str:
    trimmed = f"regexp_replace(regexp_replace({text}, '^[{_SPACE}]+', ''), '[{_SPACE}]+$', '')"
    return f"regexp_replace(lower({trimmed}), '[{_SPACE}]+', ' ', 'g')"


def _cut(label: str) -> str:
    units = f"(length({label}) + length(regexp_replace({label}, '[^\\x{{10000}}-\\x{{10ffff}}]', '', 'g')))"
    return f"({units} >= 50 AND right({label}, 1) NOT IN ('.', '!', '?', ')', '…'))"


def _first_axis(matrix: str, name: str, squarings: int = 14) -> str:
    """``name(i, v)``: the eigenvector of the largest eigenvalue of ``matrix(i, j, v)``, by squaring it again and again."""
    steps = [f"{name}0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {matrix} WHERE i = j) AS v FROM {matrix})"]
    for k in range(squarings):
        steps += [f"{name}s{k} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {name}{k} a JOIN {name}{k} b ON a.j = b.i GROUP BY ALL)",
                  f"{name}{k + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {name}s{k} WHERE i = j) AS v FROM {name}s{k})"]
    last = f"{name}{squarings}"
    # The column of the largest entry, so that this entry is positive.
    top = f"(SELECT i, v FROM {last} WHERE i = j ORDER BY v DESC, i LIMIT 1) top"
    return ", ".join([*steps, f"{name} AS MATERIALIZED (SELECT p.i, p.v / sqrt(top.v) AS v FROM {last} p JOIN {top} ON p.j = top.i)"])


_MAP = f"""
  SELECT * FROM (
    WITH centred AS MATERIALIZED (SELECT model_id, skill_id, z - avg(z) OVER (PARTITION BY model_id) AS c FROM skill_cells),
    m AS MATERIALIZED (SELECT a.skill_id AS i, b.skill_id AS j, sum(a.c * b.c) AS v FROM centred a JOIN centred b USING (model_id) GROUP BY ALL),
    {_first_axis("m", "e")},
    size AS (SELECT sum(a.v * m.v * b.v) AS v FROM m JOIN e a ON a.i = m.i JOIN e b ON b.i = m.j),
    rest AS MATERIALIZED (SELECT m.i, m.j, m.v - size.v * a.v * b.v AS v FROM m JOIN e a ON a.i = m.i JOIN e b ON b.i = m.j, size),
    {_first_axis("rest", "f")}
    SELECT e.i AS skill_id, round((e.v - min(e.v) OVER ()) / (max(e.v) OVER () - min(e.v) OVER ()), 6) AS x,
           round((f.v - min(f.v) OVER ()) / (max(f.v) OVER () - min(f.v) OVER ()), 6) AS y
    FROM e JOIN f ON e.i = f.i)"""


VIEWS = f"""
WITH cells AS (
  SELECT vec_id AS model_id, p AS skill_id,
         CASE WHEN (vec_id * 64 + p) % 97 <> 0 THEN
           greatest(0::DOUBLE, least(1::DOUBLE, floor((e::DOUBLE + 0.5::DOUBLE) * 1024) / 1024)) END AS theta
  FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(0, len(embedding))) AS p FROM embeddings)),
means AS (
  SELECT model_id, sum(coalesce(theta, 0)) / count(*) AS mean_theta FROM cells GROUP BY model_id),
raw_models AS (
  SELECT vec_id AS id,
         CASE WHEN vec_id % 2 = 0 THEN 'Model-' ELSE 'model_' END || vec_id AS name,
         CASE WHEN vec_id % 13 <> 0 THEN 'org__m__' || vec_id END AS hf_id,
         ['Llama', 'Qwen', 'Mistral', 'Gemma', 'Phi', 'Mixtral', 'Other', 'Falcon', 'Llama', 'Qwen'][label + 1] AS family,
         CASE WHEN vec_id % 5 <> 0 THEN (vec_id * 7 % 140) / 2::DOUBLE END AS params
  FROM embeddings),
models AS (
  SELECT *, CASE WHEN params IS NULL THEN 'Other' WHEN params < 10 THEN 'Small'
                 WHEN params < 40 THEN 'Mid' ELSE 'Large' END AS tier
  FROM raw_models),
respondents AS (SELECT s_suppkey AS pos, 'org__m__' || s_suppkey AS hf_id FROM supplier),
items AS (
  SELECT p_partkey AS item_id, p_size::BIGINT AS skill_id,
         CASE p_type WHEN 'ECONOMY' THEN 'MATH' WHEN 'STANDARD' THEN 'BBH' WHEN 'PROMO' THEN 'GPQA'
                     WHEN 'SMALL' THEN 'MuSR' WHEN 'MEDIUM' THEN 'IFEval' ELSE 'ARC' END AS benchmark,
         p_name AS text, (p_partkey % 32) / 32::DOUBLE + 0.5 AS alpha, (p_partkey % 17) / 16::DOUBLE AS beta
  FROM part),
responses AS (
  SELECT l_suppkey AS model_id, l_partkey AS item_id,
         max(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END)::BIGINT AS correct
  FROM lineitem GROUP BY ALL),
accuracy AS (SELECT model_id, avg(correct) AS accuracy FROM responses GROUP BY model_id),
scored AS (
  SELECT m.*, a.accuracy
  FROM models m LEFT JOIN (
    SELECT hf_id, round(accuracy, 4) AS accuracy FROM accuracy JOIN respondents ON model_id = pos) a
    ON m.hf_id = a.hf_id),
board AS (SELECT id AS model_id, name, accuracy, mean_theta FROM scored JOIN means ON id = model_id),
primary_bench AS (
  SELECT skill_id, benchmark FROM (
    SELECT skill_id, benchmark, count(*) AS n FROM items GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY skill_id ORDER BY n DESC, {_PLACE.format('benchmark')}, benchmark) = 1),
skills AS (
  SELECT p AS id, benchmark AS primary_benchmark, coalesce(n, 0) AS n_items
  FROM (SELECT DISTINCT skill_id AS p FROM cells)
  LEFT JOIN (SELECT skill_id, count(*) AS n FROM items GROUP BY skill_id) c ON c.skill_id = p
  LEFT JOIN primary_bench b ON b.skill_id = p),
grid AS (
  SELECT id AS skill_id, primary_benchmark AS benchmark,
         row_number() OVER (ORDER BY {_PLACE.format('primary_benchmark')}, first_id, id) - 1 AS pos
  FROM (SELECT *, min(id) OVER (PARTITION BY primary_benchmark) AS first_id FROM skills)),
skill_cells AS (
  SELECT model_id, skill_id, theta, coalesce(theta, 0) AS z FROM cells JOIN skills ON skill_id = id),
catalogue AS (
  SELECT doc_id AS id, text AS label, english AS label_english,
         CASE WHEN lang <> 'en' THEN lang END AS language,
         CASE doc_id % 3 WHEN 0 THEN ' ' || chr(9) || replace(text, ' ', '  ' || chr(10)) || chr(10) || ' '
                         WHEN 1 THEN coalesce(english, text) || '…' ELSE 'About ' || text END AS description,
         CASE source WHEN 'src3' THEN 'MATH' WHEN 'src1' THEN 'BBH' WHEN 'src4' THEN 'GPQA'
                     WHEN 'src0' THEN 'MuSR' WHEN 'src2' THEN 'IFEval' ELSE source END AS primary_benchmark,
         n_chars // 100 AS n_items, coalesce(english, text) AS heading
  FROM (SELECT *, CASE lang WHEN 'fr' THEN 'Translated: ' || text WHEN 'de' THEN text WHEN 'es' THEN '' END AS english
        FROM documents)),
flags AS (
  SELECT *,
         CASE WHEN {_cut('heading')} THEN heading || '…' ELSE heading END AS display,
         {_cut('heading')} AS cut,
         CASE WHEN label_english <> '' AND label <> label_english THEN label END AS original,
         n_items < 3 AS small, n_items = 1 AS singleton,
         CASE WHEN primary_benchmark IN ('MATH', 'BBH', 'GPQA', 'MuSR', 'IFEval') THEN primary_benchmark
              ELSE 'Other' END AS bench
  FROM catalogue),
dup AS (
  SELECT *, {_normalized('description')} IN ({_normalized('label')}, {_normalized('display')}) AS desc_dup FROM flags),
catalogue_benchmarks AS (
  SELECT primary_benchmark, count(*) AS n_skills,
         row_number() OVER (ORDER BY {_PLACE.format('primary_benchmark')}, min(id)) AS ord
  FROM catalogue GROUP BY primary_benchmark),
asked AS (
  SELECT c_custkey AS request_id,
         string_split(' ' || c_custkey % 700 || CASE WHEN c_nationkey % 3 = 0 THEN 'abc,x,,' ELSE ',' END
                      || c_nationkey || ',' || c_custkey * 3 % 800 || ',1', ',') AS parts
  FROM customer),
numbered AS (
  SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY place) AS place,
         try_cast(number AS BIGINT) AS model_id
  FROM (SELECT request_id, unnest(range(0, len(parts))) AS place,
               regexp_extract(unnest(parts), '^[{_SPACE}]*([+-]?[0-9]+)', 1) AS number FROM asked)
  WHERE number <> ''),
selections AS (
  SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY place) - 1 AS slot, model_id
  FROM numbered JOIN models ON model_id = id WHERE place <= 3),
compared AS (
  SELECT request_id, skill_id, slot, z
  FROM selections JOIN skill_cells USING (model_id)
  WHERE request_id IN (SELECT request_id FROM selections GROUP BY request_id HAVING count(*) >= 2)),
spreads AS (
  SELECT request_id, skill_id, min(z) AS lo, max(z) AS hi, max(z) - min(z) AS spread
  FROM compared GROUP BY ALL),
split AS (SELECT *, item_id % 5 = 0 AS heldout FROM responses),
predicted AS (
  SELECT model_id, item_id, correct, heldout, benchmark,
         1 / (1 + exp(-alpha * (coalesce(theta, 0) - beta))) AS p
  FROM split JOIN items USING (item_id)
  JOIN models ON model_id = id LEFT JOIN cells USING (model_id, skill_id)),
by_benchmark AS (
  SELECT model_id, benchmark, heldout, avg(p) AS predicted, avg(correct) AS actual, count(*) AS n
  FROM predicted GROUP BY ALL),
strongest AS (
  SELECT (SELECT model_id FROM accuracy ORDER BY accuracy DESC, model_id LIMIT 1) AS by_accuracy,
         (SELECT model_id FROM means ORDER BY mean_theta DESC, model_id LIMIT 1) AS by_mean),
outcomes AS (
  SELECT item_id, any_value(heldout) AS heldout,
         bool_or(model_id = by_accuracy AND correct = 0) AND bool_or(coalesce(params <= 13, false) AND correct = 1) AS win,
         bool_or(model_id = by_mean AND correct = 0) AND bool_or(coalesce(params <= 13, false) AND correct = 1) AS win_mean
  FROM split LEFT JOIN models ON model_id = id CROSS JOIN strongest GROUP BY item_id)
"""

_BOARD = "SELECT *, row_number() OVER (ORDER BY {}, model_id) AS rank FROM board"
_FACETS = ("contains(lower(name), '{}') AND family IN ('Llama', 'Mistral', 'Other', 'Falcon') "
           "AND tier IN ('Small', 'Mid', 'Other')")

# Several filters and orders over the same models.
_FILTERS = {
    "all": "true", "picked": _FACETS.format("model_1"), "families": "family IN ('Llama', 'Mistral', 'Other', 'Falcon')",
    "searched": "contains(lower(name), '9')", "none": "contains(lower(name), 'no such model')"}
_ORDERS = {
    "index": "id DESC", "name": "lower(name)", "acc": "accuracy DESC NULLS LAST", "mean": "mean_theta DESC", "skill": "z DESC",
    "acc_up": "accuracy ASC NULLS FIRST", "name_down": "lower(name) DESC"}


def _filtered(select: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS filter, {select} WHERE {test}" for name, test in _FILTERS.items())


def _placed(sort: str) -> str:
    return f"row_number() OVER (ORDER BY {_ORDERS[sort]}, id) AS rank"


SELECTS: dict[str, str] = {
    "read_models": "SELECT m.*, mean_theta FROM models m JOIN means ON id = model_id",
    "read_skills": """SELECT id, label, label_english, language, primary_benchmark, n_items,
                             CASE WHEN language = 'es' THEN 0 ELSE len(string_split(label, chr(10))) END AS n_examples FROM catalogue""",
    "read_skill_map": f"SELECT skill_id AS id, x, y FROM ({_MAP})",
    "skill_pca_map": _MAP,
    "read_responses": """SELECT vec_id AS model_id, unnest(range(0, len(embedding))) AS item_id,
                                CASE WHEN unnest(embedding) > 0 THEN 1 ELSE 0 END::BIGINT AS correct FROM embeddings""",
    "read_items": """SELECT id AS skill_id, i + 1 AS slot, n - i AS item_id, primary_benchmark AS benchmark, t AS text
                     FROM (SELECT id, primary_benchmark, unnest(parts) AS t, unnest(range(0, len(parts))) AS i, len(parts) AS n
                           FROM (SELECT *, string_split(label, chr(10)) AS parts FROM catalogue
                                 WHERE language IS DISTINCT FROM 'es'))""",
    "write_models": "SELECT id, name, hf_id, accuracy FROM scored",
    "check_shape": """SELECT 'shape' AS "check", (a <> b)::BIGINT + (b <> c)::BIGINT AS violations,
                             a = b AND b = c AS ok,
                             a || ' responding, ' || b || ' listed, ' || c || ' models' AS detail
                      FROM (SELECT (SELECT count(DISTINCT model_id) FROM responses) AS a,
                                   (SELECT count(*) FROM respondents) AS b, (SELECT count(*) FROM models) AS c)""",
    "check_binary": """SELECT 'binary' AS "check", n AS violations, n = 0 AS ok,
                              n || ' responses are neither 0 nor 1' AS detail
                       FROM (SELECT count(*) AS n FROM responses WHERE correct IS NULL OR correct NOT IN (0, 1))""",
    "check_alignment": """SELECT 'alignment' AS "check", n AS violations, n = 0 AS ok,
                                 n || ' positions differ in hub id' AS detail
                          FROM (SELECT count(*) AS n FROM models m FULL JOIN respondents r ON m.id = r.pos
                                WHERE m.id IS NULL OR r.pos IS NULL OR m.hf_id IS DISTINCT FROM r.hf_id)""",
    "theta_cells": "SELECT * FROM cells",
    "missing_cells": "SELECT model_id, skill_id FROM skill_cells WHERE theta IS NULL",
    "relative_cells": """SELECT model_id, skill_id, theta, theta - m AS delta,
                                CASE WHEN theta IS NOT NULL THEN least(1::DOUBLE, abs(theta - m) / 0.5) END AS magnitude,
                                theta - m >= 0 AS above
                         FROM skill_cells JOIN (SELECT skill_id, sum(z) / count(*) AS m FROM skill_cells GROUP BY skill_id)
                         USING (skill_id)""",
    "described_cells": """SELECT model_id, skill_id, theta, primary_benchmark AS benchmark, n_items
                          FROM cells JOIN skills ON skill_id = id""",
    "skill_catalogue": "SELECT id, heading, display, original, desc_dup, small, singleton, bench FROM dup",
    "catalogue_quality": """SELECT bench, count(*) AS n, count(*) FILTER (cut) AS n_cut, count(*) FILTER (desc_dup) AS n_dup,
                                   count(*) FILTER (small) AS n_small, count(language) AS n_non_english
                            FROM dup GROUP BY bench""",
    "model_catalogue": """SELECT id, name, CASE WHEN family IN ('Llama', 'Qwen', 'Mistral', 'Gemma', 'Phi', 'Mixtral')
                                 THEN family ELSE 'Other' END AS family, tier, params,
                                 regexp_replace(hf_id, '__', '/') AS hub_repo FROM models""",
    "catalogue_counts": """SELECT (SELECT count(*) FROM models) AS n_models, (SELECT count(*) FROM catalogue) AS n_skills,
                                  (SELECT count(*) FROM items) AS n_items,
                                  (SELECT count(DISTINCT primary_benchmark) FROM catalogue) AS n_benchmarks""",
    "benchmark_order": "SELECT primary_benchmark, ord FROM catalogue_benchmarks",
    "skills_per_benchmark": "SELECT primary_benchmark AS benchmark, ord, n_skills FROM catalogue_benchmarks",
    "filter_skills": "SELECT id, label, label_english FROM catalogue WHERE contains(lower(heading), 'er the')",
    "skill_match_total": "SELECT count(*) AS n FROM catalogue WHERE contains(lower(heading), 'er the')",
    "grid_order": "SELECT skill_id, pos, benchmark FROM grid",
    "group_starts": """SELECT benchmark, min(pos) AS start_pos, arg_min(skill_id, pos) AS first_skill_id
                       FROM grid GROUP BY benchmark""",
    "sector_runs": """SELECT row_number() OVER (ORDER BY min(pos)) AS run, benchmark, min(pos) AS start_pos,
                             max(pos) AS end_pos, count(*) / (SELECT count(*) FROM grid)::DOUBLE AS share
                      FROM grid GROUP BY benchmark""",
    "sector_runs_by_id": """SELECT run, benchmark, min(id) AS start_pos, max(id) AS end_pos,
                                   count(*) / (SELECT count(*) FROM skills)::DOUBLE AS share
                            FROM (SELECT id, benchmark, sum(new) OVER (ORDER BY id)::BIGINT AS run
                                  FROM (SELECT id, primary_benchmark AS benchmark,
                                               CASE WHEN id > (SELECT min(id) FROM skills)
                                                     AND lag(primary_benchmark) OVER (ORDER BY id) IS NOT DISTINCT FROM primary_benchmark
                                                    THEN 0 ELSE 1 END AS new FROM skills))
                            GROUP BY run, benchmark""",
    "skills_by_size": """SELECT primary_benchmark AS benchmark, id AS skill_id, n_items,
                                row_number() OVER (PARTITION BY primary_benchmark ORDER BY n_items DESC, id) AS rank
                         FROM skills""",
    "items_per_skill": """SELECT p AS skill_id, count(item_id) AS n_items
                          FROM (SELECT DISTINCT skill_id AS p FROM cells) LEFT JOIN items ON skill_id = p GROUP BY p""",
    "alpha_mean": "SELECT skill_id, round(avg(alpha), 9) AS alpha_mean FROM items GROUP BY skill_id",
    "primary_benchmark": "SELECT * FROM primary_bench",
    "skill_statistics": """SELECT id, any_value(primary_benchmark) AS primary_benchmark, any_value(n_items) AS n_items,
                                  round(avg(alpha), 9) AS alpha_mean
                           FROM skills JOIN items ON skill_id = id GROUP BY id""",
    "example_items": """SELECT id AS skill_id, slot, item_id, text, coalesce(shown, 0) AS shown, n_items
                        FROM catalogue LEFT JOIN (
                          SELECT id AS sid, i + 1 AS slot, n - i AS item_id, t AS text, least(n, 3) AS shown
                          FROM (SELECT id, unnest(parts) AS t, unnest(range(0, len(parts))) AS i, len(parts) AS n
                                FROM (SELECT *, string_split(label, chr(10)) AS parts FROM catalogue
                                      WHERE language IS DISTINCT FROM 'es'))
                          WHERE i < 3) ON id = sid""",
    "filter_models": f"SELECT * FROM models WHERE {_FACETS.format('model_1')}",
    "small_models": "SELECT * FROM models WHERE params <= 13",
    "filter_counts": f"SELECT count(*) FILTER ({_FACETS.format('model_1')}) AS visible, count(*) AS total FROM models",
    "model_mean_theta": "SELECT * FROM means",
    "model_mean_theta_skip": "SELECT model_id, sum(theta) / count(theta) AS mean_theta FROM cells GROUP BY model_id",
    "profile_sparkline": """SELECT model_id, b AS bucket, coalesce(value, 0) AS value
                            FROM (SELECT id AS model_id, unnest(range(0, 25)) AS b FROM models)
                            LEFT JOIN (
                              SELECT model_id, (r - 1) // per AS b, avg(z) AS value
                              FROM (SELECT model_id, coalesce(theta, 0) AS z,
                                           row_number() OVER (PARTITION BY model_id ORDER BY coalesce(theta, 0) DESC) AS r,
                                           greatest(1, count(*) OVER (PARTITION BY model_id) // 25) AS per FROM cells)
                              GROUP BY model_id, (r - 1) // per) USING (model_id, b)""",
    "ranked_skills": """SELECT model_id, skill_id, z AS theta,
                               row_number() OVER (PARTITION BY model_id ORDER BY z DESC, skill_id) AS rank FROM skill_cells""",
    "ranked_skills_grid": """SELECT model_id, skill_id, z AS theta,
                                    row_number() OVER (PARTITION BY model_id ORDER BY z DESC, pos) AS rank
                             FROM skill_cells JOIN grid USING (skill_id)""",
    "leaderboard_sort": _BOARD.format("mean_theta DESC"),
    "leaderboard_sort_index": _BOARD.format("model_id DESC"),
    "leaderboard_sort_name": _BOARD.format("lower(name)"),
    "leaderboard_sort_acc": _BOARD.format("accuracy DESC NULLS LAST"),
    "leaderboard_sort_acc_asc": _BOARD.format("accuracy ASC NULLS FIRST"),
    "leaderboard_sort_skill": """SELECT b.*, row_number() OVER (ORDER BY coalesce(theta, 0) DESC, b.model_id) AS rank
                                 FROM board b JOIN cells c ON b.model_id = c.model_id AND skill_id = 7""",
    "display_rank": f"""SELECT model_id, row_number() OVER (ORDER BY mean_theta DESC, model_id) AS rank
                        FROM models JOIN means ON id = model_id WHERE {_FACETS.format('model')}""",
    "leaderboard_ranks": f"""SELECT id AS model_id, {', '.join(f"{_placed(n)[:-8]} AS rank_{n}" for n in _ORDERS)}
                             FROM scored JOIN means ON id = means.model_id
                             JOIN (SELECT model_id, coalesce(theta, 0) AS z FROM cells WHERE skill_id = 7) c ON id = c.model_id""",
    "facet_ranks": " UNION ALL ".join(
        f"SELECT '{sort}' AS sort, * FROM ({_filtered(f'id AS model_id, {_placed(sort)} FROM scored JOIN means ON id = model_id')})"
        for sort in ("mean", "acc")),
    "facet_counts": f"SELECT *, (SELECT count(*) FROM models) AS total FROM ({_filtered('count(*) AS visible FROM models')})",
    "facet_page": f"""SELECT * FROM ({_filtered(f'{_placed("name")}, id AS model_id, name, family, tier FROM models')})
                      WHERE rank BETWEEN 13 AND 36""",
    "top_models": """SELECT row_number() OVER (ORDER BY mean_theta DESC, id) AS rank, id, name, family, tier, params,
                            accuracy, mean_theta
                     FROM scored JOIN means ON id = model_id QUALIFY rank <= 12""",
    "leaderboard_grid": f"""SELECT rank, b.* EXCLUDE (rank), c.* EXCLUDE (model_id)
                            FROM ({_BOARD.format('accuracy DESC NULLS LAST')}) b
                            JOIN (SELECT model_id, {', '.join(
                                f'max(theta) FILTER (skill_id = {s}) AS s{s}' for s in range(64))}
                                  FROM cells GROUP BY model_id) c ON b.model_id = c.model_id""",
    "matrix_slice": """SELECT rank, model_id, skill_id, coalesce(theta, 0) AS theta
                       FROM cells JOIN (SELECT model_id, row_number() OVER (ORDER BY mean_theta DESC, model_id) AS rank
                                        FROM means QUALIFY rank <= 9) USING (model_id)
                       WHERE skill_id % 7 = 2 AND skill_id < 100
                       UNION ALL
                       SELECT rank, model_id, c AS skill_id, 0 AS theta
                       FROM (SELECT model_id, row_number() OVER (ORDER BY mean_theta DESC, model_id) AS rank
                             FROM means QUALIFY rank <= 9), range(2, 100, 7) t(c)
                       WHERE (model_id, c) NOT IN (SELECT model_id, skill_id FROM cells)""",
    "attach_accuracy": "SELECT id, name, hf_id, accuracy FROM scored",
    "skill_means": "SELECT skill_id, sum(z) / count(*) AS mean_theta FROM skill_cells GROUP BY skill_id",
    "skill_means_skip": "SELECT skill_id, sum(theta) / count(theta) AS mean_theta FROM skill_cells GROUP BY skill_id",
    "skill_histograms": """SELECT skill_id, bin, n, n / greatest(1, max(n) OVER (PARTITION BY skill_id))::DOUBLE AS height
                           FROM (SELECT s.id AS skill_id, b AS bin, count(z) AS n
                                 FROM (SELECT id, unnest(range(0, 16)) AS b FROM skills) s
                                 LEFT JOIN skill_cells c ON c.skill_id = s.id AND least(15, floor(z * 16)) = b
                                 GROUP BY ALL)""",
    "theta_variance": "SELECT skill_id, round(var_pop(z), 9) AS variance FROM skill_cells GROUP BY skill_id",
    "best_model_per_skill": """SELECT skill_id, model_id, name, z AS theta FROM skill_cells JOIN models ON model_id = id
                               QUALIFY row_number() OVER (PARTITION BY skill_id ORDER BY z DESC, model_id) = 1""",
    "top_models_per_skill": """SELECT skill_id, row_number() OVER (PARTITION BY skill_id ORDER BY z DESC, model_id) AS rank,
                                      model_id, name, family, tier, params, z AS theta
                               FROM skill_cells JOIN models ON model_id = id QUALIFY rank <= 10""",
    "model_accuracy": "SELECT model_id, round(accuracy, 4) AS accuracy FROM accuracy",
    "accuracy_summary": """SELECT count(*) AS n, round(min(accuracy), 9) AS "min", round(max(accuracy), 9) AS "max",
                                  round(avg(accuracy), 9) AS mean FROM accuracy""",
    "resolve_selections": "SELECT * FROM selections",
    "skill_spread": "SELECT * FROM spreads",
    "divergent_skills": """SELECT request_id, skill_id, spread,
                                  row_number() OVER (PARTITION BY request_id ORDER BY spread DESC, pos) AS rank
                           FROM spreads JOIN grid USING (skill_id) QUALIFY rank <= 10""",
    "lead_counts": """SELECT request_id, count(*) FILTER (a > b) AS a_wins, count(*) FILTER (b > a) AS b_wins,
                             count(*) AS n_skills
                      FROM (SELECT request_id, skill_id, max(z) FILTER (slot = 0) AS a, max(z) FILTER (slot = 1) AS b
                            FROM compared GROUP BY ALL) GROUP BY request_id""",
    "compare_suggestion": """SELECT * FROM (
                               SELECT (SELECT id FROM models JOIN means ON id = model_id
                                       ORDER BY mean_theta DESC, id LIMIT 1) AS best_id,
                                      (SELECT id FROM models JOIN means ON id = model_id WHERE params <= 13
                                       ORDER BY mean_theta DESC, id LIMIT 1) AS best_small_id)
                             WHERE best_id <> best_small_id""",
    "heldout_split": "SELECT * FROM split",
    "irt_probability": "SELECT model_id, item_id, correct, round(p, 6) AS p FROM predicted",
    "benchmark_prediction": """SELECT model_id, benchmark, heldout, round(predicted, 6) AS predicted,
                                      round(actual, 6) AS actual, n FROM by_benchmark""",
    "prediction_quality": """SELECT benchmark, heldout, round(avg(abs(predicted - actual)), 6) AS mae,
                                    round(sqrt(avg((predicted - actual) * (predicted - actual))), 6) AS rmse,
                                    round(corr(predicted, actual), 6) AS corr, count(*) AS n_models
                             FROM by_benchmark GROUP BY ALL""",
    "weak_beats_strong": """SELECT heldout, count(*) AS n_items, count(*) FILTER (win) AS n_wins,
                                   round(count(*) FILTER (win) / count(*)::DOUBLE, 9) AS share
                            FROM outcomes GROUP BY heldout""",
    "weak_beats_strong_by_mean": """SELECT heldout, count(*) AS n_items, count(*) FILTER (win_mean) AS n_wins,
                                           round(count(*) FILTER (win_mean) / count(*)::DOUBLE, 9) AS share
                                    FROM outcomes GROUP BY heldout""",
    "weak_beats_strong_by_skill": """SELECT *, row_number() OVER (PARTITION BY heldout ORDER BY share DESC, skill_id) AS rank
                                     FROM (SELECT heldout, skill_id, count(*) AS n_items, count(*) FILTER (win) AS n_wins,
                                                  round(count(*) FILTER (win) / count(*)::DOUBLE, 9) AS share
                                           FROM outcomes JOIN items USING (item_id) GROUP BY heldout, skill_id)
                                     QUALIFY rank <= 12""",
    "described_map": f"""SELECT map.skill_id, x, y,
                               primary_benchmark AS benchmark, n_items, name AS best_name, z AS best_theta
                        FROM ({_MAP}) map JOIN skills ON map.skill_id = skills.id
                        JOIN (SELECT skill_id, name, z FROM skill_cells JOIN models ON model_id = id
                              QUALIFY row_number() OVER (PARTITION BY skill_id ORDER BY z DESC, model_id) = 1) b
                          ON b.skill_id = map.skill_id""",
}

SELECTS |= {
    **{f"read_models_{form}": SELECTS["read_models"] for form in ("array", "wrapped", "parquet")},
    "read_skills_array": SELECTS["read_skills"],
    "read_cells": SELECTS["theta_cells"],
    "stored_probability": SELECTS["irt_probability"],
    "stored_prediction": SELECTS["benchmark_prediction"],
    "skill_products": """SELECT a.skill_id, b.skill_id AS other_id, sum(a.z * b.z) AS product
                         FROM skill_cells a JOIN skill_cells b ON a.model_id = b.model_id AND a.skill_id <= b.skill_id
                         GROUP BY ALL""",
    "check_shape_dense": """SELECT 'shape' AS "check", 0::BIGINT AS violations, true AS ok,
                                   n || ' responding, ' || n || ' listed, ' || n || ' models' AS detail
                            FROM (SELECT count(*) AS n FROM embeddings)""",
    "check_binary_dense": """SELECT 'binary' AS "check", 0::BIGINT AS violations, true AS ok,
                                    '0 responses are neither 0 nor 1' AS detail""",
    "check_alignment_dense": """SELECT 'alignment' AS "check", 0::BIGINT AS violations, true AS ok,
                                       '0 positions differ in hub id' AS detail""",
    "enrich_models": """SELECT id * 3 + 7 AS id, name, hf_id,
                               round(len(list_filter(embedding, lambda e: e > 0)) / len(embedding)::DOUBLE, 4) AS accuracy
                        FROM models JOIN embeddings ON id = vec_id""",
    "responses_by_model": """SELECT vec_id * 3 + 7 AS model_id, unnest(range(0, len(embedding))) AS item_id,
                                    CASE WHEN unnest(embedding) > 0 THEN 1 ELSE 0 END::BIGINT AS correct FROM embeddings""",
    "skill_spread_many": """SELECT request_id, skill_id, min(z) AS lo, max(z) AS hi, max(z) - min(z) AS spread
                            FROM (SELECT request_id, model_id FROM numbered JOIN models ON model_id = id
                                  WHERE request_id IN (SELECT request_id FROM numbered JOIN models ON model_id = id
                                                       GROUP BY request_id HAVING count(*) >= 2))
                            JOIN skill_cells USING (model_id) GROUP BY ALL""",
    "unmatched_responses": """SELECT count(*) AS n, count(*) FILTER (item_id NOT IN (SELECT item_id FROM items)) AS n_without_item,
                                     count(*) FILTER (model_id NOT IN (SELECT id FROM models)) AS n_without_model
                              FROM responses""",
}

ORACLE = {name: f"{VIEWS}\n{select}" for name, select in SELECTS.items()}
