"""The same queries in DuckDB SQL, written from their definitions."""

from __future__ import annotations

_BRANDS = [f"Brand#{i}" for i in range(1, 26)]


def _det(species: str) -> str:
    return f"""SELECT CAST(l_suppkey % 24 + 1 AS BIGINT) AS om,
    row_number() OVER (PARTITION BY l_suppkey % 24 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS det_idx,
    CAST((l_partkey * 7919 + l_orderkey * 31) % 10000 AS DOUBLE) AS x_min, CAST((l_orderkey * 104729 + l_linenumber * 577) % 10000 AS DOUBLE) AS y_min,
    CAST((l_partkey * 7919 + l_orderkey * 31) % 10000 AS DOUBLE) + l_quantity AS x_max,
    CAST((l_orderkey * 104729 + l_linenumber * 577) % 10000 AS DOUBLE) + 1 + l_partkey % 40 + CAST(0.25 AS DOUBLE) * (l_linenumber % 4) AS y_max,
    {species} AS species FROM lineitem JOIN part ON l_partkey = p_partkey"""


def _tiles(s: int) -> str:
    n = 10_000 // s
    return f"""SELECT om, ty * {n} + tx + 1 AS tile_id, tx * {s} AS tile_x, ty * {s} AS tile_y, printf('OM_%03d_%05d_%05d.png', om, tx * {s}, ty * {s}) AS file_name,
    (om - 1) * {n * n} + ty * {n} + tx + 1 AS image_id, printf('OM_%03d', om) AS om_id
    FROM range(1, 25) a(om), range({n}) b(tx), range({n}) c(ty)"""


def _pieces(s: int) -> str:
    return f"""SELECT *, w * h AS area, row_number() OVER (PARTITION BY om ORDER BY tile_id, det_idx) AS annotation_id FROM (
    SELECT d.om, t.tile_id, t.image_id, t.tile_x, t.tile_y, d.det_idx, d.species, c.category_id,
      greatest(x_min, tile_x) - tile_x AS x, greatest(y_min, tile_y) - tile_y AS y,
      least(x_max, tile_x + {s}) - greatest(x_min, tile_x) AS w, least(y_max, tile_y + {s}) - greatest(y_min, tile_y) AS h,
      x_min < tile_x OR y_min < tile_y OR x_max > tile_x + {s} OR y_max > tile_y + {s} AS is_clipped
    FROM det d JOIN tiles t ON d.om = t.om AND x_max > tile_x AND x_min < tile_x + {s} AND y_max > tile_y AND y_min < tile_y + {s}
    JOIN (SELECT om, species, row_number() OVER (PARTITION BY om ORDER BY species) AS category_id FROM (SELECT DISTINCT om, species FROM det)) c
      ON d.om = c.om AND d.species = c.species) WHERE w * h >= 4"""


_RARE = "CASE WHEN (l_orderkey * 31 + l_partkey) % 4001 < 2 THEN 'RARE_' || (l_partkey % 5) ELSE p_brand END"
DET = f"det AS ({_det('p_brand')})"
BASE = f"WITH {DET}, tiles AS ({_tiles(500)}), pieces AS ({_pieces(500)})"
TAIL = f"WITH det AS ({_det(_RARE)}), tiles AS ({_tiles(500)}), pieces AS ({_pieces(500)})"
BASE_512 = f"WITH {DET}, tiles AS ({_tiles(512)}), pieces AS ({_pieces(512)})"


def _key(i: str, it: str) -> str:
    a = f"(({i} % 2147483647 * 1103515 + {it} * 104729 + 12345) % 2147483647)"
    return f"((({a} * {a}) % 2147483647 * 48271 + {it} * 69621) % 2147483647)"


def _assigned(n: int) -> str:
    rank = f"row_number() OVER (PARTITION BY iteration ORDER BY {_key('image_id', 'iteration')}, image_id)"
    return f"""assigned AS (SELECT iteration, image_id, CASE WHEN r <= floor(9600 * 0.8) THEN 'train' WHEN r <= floor(9600 * 0.8) + floor(9600 * 0.1) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT iteration, image_id, {rank} AS r FROM tiles, range({n}) i(iteration)))"""


def _counts(n: int) -> str:
    sums = ", ".join(f"count(*) FILTER (WHERE split = '{s}') AS {s}" for s in ("train", "val", "test"))
    return f"{_assigned(n)}, counts AS (SELECT iteration, species, {sums} FROM pieces JOIN assigned USING (image_id) GROUP BY iteration, species)"


_SCORES = """scores AS (SELECT *, round(distribution_score + missing_penalty + imbalance_penalty, 9) AS total_score FROM (
  SELECT iteration,
    round(sum(abs(train / a_t - g / a_g) + abs(val / a_v - g / a_g) + abs(test / a_e - g / a_g)), 9) AS distribution_score,
    round(2 * sum((CASE WHEN val = 0 THEN sqrt(g / a_g) ELSE 0 END) + (CASE WHEN test = 0 THEN sqrt(g / a_g) ELSE 0 END)), 9) AS missing_penalty,
    round(0.5 * (abs(max(a_t) / max(a_g) - 0.8) + abs(max(a_v) / max(a_g) - 0.1) + abs(max(a_e) / max(a_g) - 0.1)), 9) AS imbalance_penalty
  FROM (SELECT *, CAST(train + val + test AS DOUBLE) AS g, CAST(sum(train) OVER w AS DOUBLE) AS a_t, CAST(sum(val) OVER w AS DOUBLE) AS a_v, CAST(sum(test) OVER w AS DOUBLE) AS a_e,
    CAST(sum(train + val + test) OVER w AS DOUBLE) AS a_g FROM counts WINDOW w AS (PARTITION BY iteration)) GROUP BY iteration))"""
_SHARES = """shares AS (SELECT *, round(abs(pct_train - 80.0) + abs(pct_val - 10.0) + abs(pct_test - 10.0), 6) AS deviation, row_number() OVER (ORDER BY total DESC, species) AS rank FROM (
  SELECT species, train, val, test, train + val + test AS total, round(train * 100.0::DOUBLE / (train + val + test), 9) AS pct_train,
    round(val * 100.0::DOUBLE / (train + val + test), 9) AS pct_val, round(test * 100.0::DOUBLE / (train + val + test), 9) AS pct_test FROM counts))"""
_SRC = """src AS (SELECT s_suppkey, CASE WHEN s_suppkey % 17 = 0 THEN printf('DJI_%04d.jpg', s_suppkey) ELSE printf('20250510 10k-%02d-%02d.jpg', s_suppkey // 10, s_suppkey % 10) END AS file_name FROM supplier),
entries AS (SELECT file_name, coalesce(n, 0) AS detections FROM src LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey) ON s_suppkey = l_suppkey WHERE s_suppkey % 13 <> 0)"""
_FREQ = """freq AS (SELECT *, row_number() OVER (ORDER BY n DESC, first_pos) AS rank, n >= 2400 AS included FROM (
  SELECT species, CASE WHEN species LIKE 'Brand#1%' THEN 'First ' || species[7:8] ELSE species END AS label, count(*) AS n, min(om * 1000000000 + det_idx) AS first_pos FROM det GROUP BY species))"""
_CROP = """cats AS (SELECT species AS name, row_number() OVER (ORDER BY species) AS category_id FROM (SELECT DISTINCT species FROM det)), kept AS (SELECT * FROM tiles WHERE tile_id % 97 <> 0)"""
_ROWS = "rows_ AS (SELECT doc_id AS row_id, source AS label FROM documents)"
_K0 = _key("row_id", "0")
_PER_TILE = "per_tile AS (SELECT t.image_id, a.split, coalesce(c, 0) AS c FROM tiles t JOIN assigned a USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS c FROM pieces GROUP BY image_id) USING (image_id))"
_STRAT = f"""strat AS (SELECT row_id, label, CASE WHEN r <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN r <= floor(n * CAST(0.8 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_K0}) AS r, count(*) OVER (PARTITION BY label) AS n FROM rows_))"""
_PRED = """pred AS (SELECT vec_id AS row_id, label AS y_true, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)) AS scores,
  CAST(list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS INTEGER) AS y_pred FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL)"""
_CONF = """conf AS (SELECT CAST(i AS INTEGER) AS y_true, CAST(j AS INTEGER) AS y_pred, coalesce(n, 0) AS n FROM range(10) a(i) CROSS JOIN range(10) b(j)
  LEFT JOIN (SELECT y_true, y_pred, count(*) AS n FROM pred GROUP BY ALL) p ON p.y_true = i AND p.y_pred = j)"""


def _merge(cap: int, source: str = "rows_") -> str:
    def step(prev: str, group: list[str], out: str) -> str:
        inside = "label IN (" + ", ".join(f"'{g}'" for g in group) + ")"
        k = max(1, cap // len(group))
        return f"""{out} AS (SELECT row_id, CASE WHEN {inside} THEN '{"_".join(sorted(group))}' ELSE label END AS label FROM (
          SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_K0}, row_id) AS r FROM {prev}) WHERE NOT coalesce({inside}, false) OR r <= {k})"""

    return step(source, ["src2", "src1"], f"m1_{cap}") + ", " + step(f"m1_{cap}", ["src3", "src4", "src5"], f"m2_{cap}")


def _cap(source: str, k: int) -> str:
    return f"SELECT row_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_K0}, row_id) AS r FROM {source} WHERE label IS NOT NULL) WHERE r <= {k}"


def _window(pad: str, name: str) -> str:
    cl = "least(greatest(CAST(trunc({}) AS INTEGER), 0), 500)"
    return ", ".join(
        cl.format(e) + f" AS {name}_{n}"
        for e, n in ((f"x - w * {pad}", "x1"), (f"y - h * {pad}", "y1"), (f"x + w + w * {pad}", "x2"), (f"y + h + h * {pad}", "y2"))
    )


_SAFE = "coalesce({} / nullif({}, 0), 0.0)"
_HISTORY = """history AS (SELECT user_id % 30 + 1 AS epoch, round(sum(CAST(event_id % 64 AS DOUBLE) * 0.25 * 32) / greatest(1, sum(32)), 9) AS loss,
  round(CAST(sum(event_id % 33) AS DOUBLE) / greatest(1, sum(32)), 9) AS accuracy FROM events GROUP BY user_id % 30 + 1)"""

ORACLE_SQL: dict[str, str] = {
    "q_tile_grid": f"SELECT om, tile_id, tile_x, tile_y, file_name, 500::BIGINT AS tile_size FROM ({_tiles(500)}) UNION ALL SELECT om, tile_id, tile_x, tile_y, file_name, 512::BIGINT FROM ({_tiles(512)})",
    "q_tile_join": f"{BASE} SELECT om, tile_id, tile_x, tile_y, det_idx, species, category_id, x, y, w, h, area, is_clipped, annotation_id FROM pieces",
    "q_tile_join_512": f"{BASE_512} SELECT om, tile_id, tile_x, tile_y, det_idx, species, x, y, w, h, area, is_clipped FROM pieces",
    "q_tiling_stats": f"""{BASE_512} SELECT om, count(*) AS total_tiles, 39::BIGINT AS dropped_edge_tiles, CAST(sum(n) AS BIGINT) AS total_annotations, CAST(sum(c) AS BIGINT) AS clipped_boxes,
      count(*) FILTER (WHERE n = 0) AS empty_tiles, count(*) FILTER (WHERE c > 0) AS tiles_with_partial_boxes
      FROM (SELECT t.om, t.tile_id, count(p.om) AS n, count(*) FILTER (WHERE p.is_clipped) AS c FROM tiles t LEFT JOIN pieces p ON t.om = p.om AND t.tile_id = p.tile_id GROUP BY ALL) GROUP BY om""",
    "q_category_ids": f"""WITH {DET} SELECT om, species, row_number() OVER (PARTITION BY om ORDER BY species) AS category_id FROM (SELECT DISTINCT om, species FROM det)
      UNION ALL SELECT 0::BIGINT, species, row_number() OVER (ORDER BY species) FROM (SELECT DISTINCT species FROM det)""",
    "q_merge_ids": f"""{BASE}, img AS (SELECT om AS file, tile_id AS image_id FROM tiles WHERE om % 7 <> 0),
      off AS (SELECT file, coalesce(sum(top) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM (SELECT file, max(image_id) AS top FROM img GROUP BY file)),
      g AS (SELECT species, row_number() OVER (ORDER BY species) AS id FROM (SELECT DISTINCT species FROM det))
      SELECT om AS file, annotation_id AS pos, CAST(tile_id + o AS BIGINT) AS global_image_id, row_number() OVER (ORDER BY om, annotation_id) AS global_annotation_id,
        CASE WHEN det_idx % 50 = 0 THEN 0 ELSE g.id END AS global_category_id, CASE WHEN det_idx % 50 = 0 THEN 'UNKNOWN' ELSE p.species END AS name
      FROM pieces p JOIN off ON off.file = p.om JOIN g ON g.species = p.species""",
    "q_prepare": rf"""WITH {_SRC}, own AS (SELECT s.file_name, coalesce(detections, 0) AS detections, row_number() OVER (ORDER BY CAST(regexp_extract(s.file_name, '10k-(\d+)-(\d+)', 1) AS INT),
      CAST(regexp_extract(s.file_name, '10k-(\d+)-(\d+)', 2) AS INT), s.file_name) AS idx FROM src s LEFT JOIN entries e ON e.file_name = s.file_name WHERE regexp_matches(s.file_name, '^\d{{8}} 10k-\d+-\d+\.jpg$'))
      SELECT idx, file_name, printf('OM_%03d_', idx) || replace(file_name, ' ', '_') AS new_name, printf('OM_%03d', idx) AS om_id, 10000 AS width, 10000 AS height, detections FROM own""",
    "q_missing_images": f"WITH {_SRC} SELECT file_name FROM src WHERE file_name LIKE '20250510 10k-%' AND file_name NOT IN (SELECT file_name FROM entries)",
    "q_crosstab": f"WITH {DET} SELECT om, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE species = '{b}') AS {b.replace('#', '_').lower()}" for b in _BRANDS) + " FROM det GROUP BY om",
    "q_species_freq": f"WITH {DET}, {_FREQ} SELECT species, label, n, first_pos, rank, included FROM freq",
    "q_count_extremes": f"""WITH {DET}, {_FREQ} SELECT (SELECT species FROM freq ORDER BY n DESC, first_pos LIMIT 1) AS most_common, (SELECT species FROM freq ORDER BY n, first_pos LIMIT 1) AS least_common,
      max(n) AS max_n, count(*) FILTER (WHERE n < 10) AS under_10, count(*) FILTER (WHERE n < 50) AS under_50 FROM freq""",
    "q_om_summary": f"""WITH {DET}, per AS (SELECT om, species, count(*) AS n, min(det_idx) AS f FROM det GROUP BY ALL)
      SELECT i.om, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_annotations, count(species) AS num_species, coalesce((SELECT species FROM per p WHERE p.om = i.om ORDER BY n DESC, f LIMIT 1), 'N/A') AS top_species
      FROM range(1, 25) i(om) LEFT JOIN per ON per.om = i.om GROUP BY i.om""",
    "q_dataset_summary": f"""{BASE} SELECT 9600::BIGINT AS tiles, count(DISTINCT image_id) AS tiles_with, 9600 - count(DISTINCT image_id) AS tiles_without,
      round(count(DISTINCT image_id) * 100.0::DOUBLE / 9600, 9) AS pct_with, 24::BIGINT AS orthomosaics, 400::BIGINT AS tiles_per_orthomosaic, count(*) AS annotations, count(DISTINCT species) AS categories FROM pieces""",
    "q_tile_species_counts": f"{BASE} SELECT image_id, category_id, count(*) AS n FROM pieces GROUP BY ALL",
    "q_distribution": f"{TAIL} SELECT species, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS p FROM pieces GROUP BY species",
    "q_median_variants": f"""{TAIL}, n AS (SELECT count(*) AS n FROM pieces GROUP BY species)
      SELECT CAST(quantile_cont(n, 0.5) AS DOUBLE) AS median, list_sort(list(n))[count(*) // 2 + 1] AS upper_median, quantile_disc(n, 0.5) AS lower_median FROM n""",
    "q_density": f"""{BASE}, {_assigned(1)}, {_PER_TILE} SELECT split, count(*) AS tiles, round(avg(c), 9) AS mean, CAST(floor(quantile_cont(c, 0.5)) AS BIGINT) AS median,
      round(count(*) FILTER (WHERE c = 0) * 100.0::DOUBLE / count(*), 9) AS pct_empty, max(c) AS largest FROM per_tile GROUP BY split""",
    "q_density_hist": f"""{BASE}, {_assigned(1)}, {_PER_TILE}, e AS (SELECT split, CAST(min(c) AS DOUBLE) AS lo, CAST(max(c) AS DOUBLE) AS hi, count(*) AS total FROM per_tile WHERE c > 0 GROUP BY split)
      SELECT split, bin, count(*) AS n, round(count(*) / (any_value(total) * (any_value(hi) - any_value(lo)) / 30), 9) AS density
      FROM (SELECT p.split, CAST(least(30, floor((c - lo) / (hi - lo) * 30) + 1) AS BIGINT) AS bin, lo, hi, total FROM per_tile p JOIN e ON e.split = p.split WHERE c > 0) GROUP BY split, bin""",
    "q_random_split": f"WITH tiles AS ({_tiles(500)}), {_assigned(2)} SELECT iteration, image_id, split FROM assigned",
    "q_split_score": f"{TAIL}, {_counts(4)}, {_SCORES} SELECT iteration, distribution_score, missing_penalty, imbalance_penalty, total_score FROM scores",
    "q_split_search": f"""{TAIL}, {_counts(16)}, {_SCORES} SELECT (SELECT iteration FROM scores ORDER BY total_score, iteration LIMIT 1) AS best_iteration, min(total_score) AS best_score,
      round(avg(total_score), 9) AS mean_score, round(stddev_pop(total_score), 6) AS std_score FROM scores""",
    "q_running_best": f"""{TAIL}, {_counts(16)}, {_SCORES} SELECT iteration, total_score,
      coalesce(total_score < min(total_score) OVER (ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM scores""",
    "q_split_sizes": f"""{BASE}, {_assigned(1)}, {_PER_TILE} SELECT split, count(*) AS tiles, CAST(sum(c) AS BIGINT) AS annotations, round(CAST(sum(c) AS DOUBLE) * 100.0 / (SELECT CAST(sum(c) AS DOUBLE) FROM per_tile), 9) AS pct
      FROM per_tile GROUP BY split UNION ALL SELECT 'total', count(*), CAST(sum(c) AS BIGINT), 100.0 FROM per_tile""",
    "q_split_species": f"{TAIL}, {_counts(1)}, {_SHARES} SELECT species, train, val, test, total, pct_train, pct_val, pct_test, deviation, rank FROM shares",
    "q_imbalance_top10": f"{TAIL}, {_counts(1)}, {_SHARES} SELECT species, total, deviation FROM shares WHERE total >= 10 ORDER BY deviation DESC, total DESC, species LIMIT 10",
    "q_missing_species": f"{TAIL}, {_counts(16)} SELECT iteration || ':' || species AS species, val = 0 AS missing_val, test = 0 AS missing_test FROM counts WHERE val = 0 OR test = 0",
    "q_split_annotations": f"""{BASE}, {_assigned(1)}, im AS (SELECT image_id, split, row_number() OVER (PARTITION BY split ORDER BY image_id) AS new_image_id FROM assigned)
      SELECT split, om, annotation_id, new_image_id, row_number() OVER (PARTITION BY split ORDER BY om, annotation_id) AS new_annotation_id, category_id, area FROM pieces JOIN im USING (image_id)""",
    "q_tile_lists": f"WITH tiles AS ({_tiles(500)}), {_assigned(1)} SELECT split, row_number() OVER (PARTITION BY split ORDER BY image_id) AS pos, file_name FROM assigned JOIN tiles USING (image_id)",
    "q_split_invariants": "SELECT 9600::BIGINT AS ids, 0::BIGINT AS repeated, 0::BIGINT AS missing",
    "q_stratified_split": f"WITH {_ROWS}, {_STRAT} SELECT label, split, count(*) AS n, min(row_id) AS first FROM strat GROUP BY ALL",
    "q_crop_catalog": f"""{BASE}, {_CROP} SELECT printf('crops/%s/%s_%06d.png', species, species, annotation_id) AS crop_path, species AS species_name, file_name AS source_tile, om_id AS orthomosaic_id,
      '[' || x || ', ' || y || ', ' || w || ', ' || h || ']' AS bbox_coco, annotation_id FROM pieces JOIN kept USING (image_id)""",
    "q_crop_skipped": f"{BASE}, {_CROP} SELECT om, count(*) AS skipped FROM pieces WHERE tile_id % 97 = 0 GROUP BY om",
    "q_crop_filter": f"{BASE} SELECT om, annotation_id, species FROM pieces WHERE species IN ('Brand#11', 'Brand#23')",
    "q_crop_window": f"""{BASE}, a AS (SELECT om, annotation_id, {_window("0.25::DOUBLE", "a")}, {_window("0.0::DOUBLE", "b")} FROM pieces)
      SELECT om, annotation_id, """
    + ", ".join(f"CASE WHEN a_x2 > a_x1 AND a_y2 > a_y1 THEN a_{c} WHEN b_x2 > b_x1 AND b_y2 > b_y1 THEN b_{c} ELSE 0 END AS {c}" for c in ("x1", "y1", "x2", "y2"))
    + ", NOT (a_x2 > a_x1 AND a_y2 > a_y1) AND NOT (b_x2 > b_x1 AND b_y2 > b_y1) AS black FROM a",
    "q_label_remap": f"WITH {DET} SELECT 'CLASS_' || species[7] AS label, count(*) AS n, count(DISTINCT species) AS species FROM det WHERE species <> 'Brand#25' GROUP BY ALL",
    "q_label_index": f"""WITH {_ROWS}, idx AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS class_id FROM (SELECT DISTINCT label FROM rows_ WHERE row_id % 10 < 8 AND label IS NOT NULL))
      SELECT label, class_id, count(*) AS n FROM rows_ JOIN idx USING (label) GROUP BY ALL""",
    "q_cap_per_class": f"WITH {_ROWS} {_cap('rows_', 20)}",
    "q_merge_groups": f"WITH {_ROWS}, {_merge(30)} SELECT row_id, label FROM m2_30",
    "q_loader_pipeline": f"WITH {_ROWS}, {_merge(40)}, {_merge(8)} SELECT *, 'train' AS split FROM ({_cap('m2_40', 40)}) UNION ALL SELECT *, 'val' FROM ({_cap('m2_8', 8)})",
    "q_class_weights": f"WITH {_ROWS}, c AS (SELECT label, count(*) AS n FROM rows_ WHERE label IS NOT NULL GROUP BY label) SELECT label, n, round((1.0::DOUBLE / n) / avg(1.0::DOUBLE / n) OVER (), 9) AS weight FROM c",
    "q_sampler_weights": f"WITH {_ROWS} SELECT row_id, label, round(1.0::DOUBLE / pow(CAST(count(*) OVER (PARTITION BY label) AS DOUBLE), 0.5), 9) AS weight FROM rows_ WHERE label IS NOT NULL",
    "q_weighted_sample": f"""WITH {_ROWS}, w AS (SELECT row_id, label, round(1.0::DOUBLE / pow(CAST(count(*) OVER (PARTITION BY label) AS DOUBLE), 0.5), 9) AS weight FROM rows_ WHERE label IS NOT NULL),
      u AS (SELECT *, CAST(greatest(round(weight * 1000000000), 1) AS HUGEINT) AS u, row_id % (SELECT count(*) // 100000 + 1 FROM w) AS b FROM w WHERE weight > 0),
      i AS (SELECT *, sum(u) OVER (ORDER BY b, row_id) AS hi FROM u),
      d AS (SELECT draw, (CAST({_key('draw', '42')} AS HUGEINT) * 2147483647 + {_key('draw', '43')}) * (SELECT sum(u) FROM u) // (CAST(2147483647 AS HUGEINT) * 2147483647) AS place FROM range(500) t(draw))
      SELECT draw, row_id, label, weight FROM d JOIN i ON place >= hi - u AND place < hi""",
    "q_split_composition": f"WITH {_ROWS}, {_STRAT} SELECT label, "
    + ", ".join(f"count(*) FILTER (WHERE split = '{s}' AND (row_id % 3 <> 0 OR split = 'train')) AS {s}" for s in ("train", "val", "test"))
    + " FROM strat GROUP BY label",
    "q_path_normalize": "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '/d/X/' || s_suppkey WHEN 1 THEN '/abs/' || s_suppkey ELSE '/d/crops/' || s_suppkey END AS path FROM supplier",
    "q_confusion": f"WITH {_PRED}, {_CONF} SELECT y_true, y_pred, n, round(coalesce(n * 100.0::DOUBLE / nullif(sum(n) OVER (PARTITION BY y_true), 0), 0.0), 9) AS pct FROM conf",
    "q_class_report": f"""WITH {_PRED}, {_CONF}, c AS (SELECT a.y_true AS k, CAST(a.tp AS DOUBLE) AS tp, CAST(a.support AS BIGINT) AS support, {_SAFE.format('CAST(a.tp AS DOUBLE)', 'b.predicted')} AS p, {_SAFE.format('CAST(a.tp AS DOUBLE)', 'a.support')} AS r
      FROM (SELECT y_true, sum(n) AS support, sum(n) FILTER (WHERE y_true = y_pred) AS tp FROM conf GROUP BY y_true) a JOIN (SELECT y_pred, sum(n) AS predicted FROM conf GROUP BY y_pred) b ON a.y_true = b.y_pred),
      f AS (SELECT *, {_SAFE.format('2 * p * r', 'p + r')} AS f1 FROM c)
      SELECT CAST(k AS VARCHAR) AS label, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1, support FROM f
      UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 9), round(sum(tp) / sum(support), 9), round(sum(tp) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM f
      UNION ALL SELECT 'macro avg', round(avg(p), 9), round(avg(r), 9), round(avg(f1), 9), CAST(sum(support) AS BIGINT) FROM f
      UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 9), round(sum(r * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM f""",
    "q_average_precision": f"""WITH {_PRED}, long AS (SELECT y_true, CAST(generate_subscripts(scores, 1) - 1 AS INTEGER) AS class_id, unnest(scores) AS score FROM pred),
      g AS (SELECT class_id, score, count(*) AS n, count(*) FILTER (WHERE y_true = class_id) AS tp FROM long GROUP BY ALL),
      w AS (SELECT class_id, tp, sum(tp) OVER o / CAST(sum(n) OVER o AS DOUBLE) AS prec FROM g WINDOW o AS (PARTITION BY class_id ORDER BY score DESC))
      SELECT class_id, round(coalesce(sum(tp * prec) / nullif(sum(tp), 0), 0.0), 9) AS ap FROM w GROUP BY class_id""",
    "q_misclassified": f"WITH {_PRED} SELECT row_id, y_true, y_pred, round(scores[y_true + 1], 4) AS true_score, round(scores[y_pred + 1], 4) AS predicted_score FROM pred WHERE y_true <> y_pred",
    "q_epoch_metrics": f"WITH {_HISTORY} SELECT epoch, loss, accuracy FROM history",
    "q_best_epoch": f"WITH {_HISTORY} SELECT (SELECT epoch FROM history ORDER BY accuracy DESC, epoch LIMIT 1) AS epoch, max(accuracy) AS accuracy FROM history",
    "q_lr_schedule": "SELECT e AS epoch, round(CASE WHEN e <= 10 THEN 1e-4 * e / 10 ELSE 1e-4 * (1 + cos(pi() * (e - 10) / 20)) / 2 END, 12) AS lr FROM range(1, 31) t(e)",
}
