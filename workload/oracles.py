"""The same results in plain SQL over the given tables, written independently of the operators."""

from __future__ import annotations

SUFFIX = """CASE {id} % 8 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MOV' WHEN 2 THEN '.webm' WHEN 3 THEN '.gif'
 WHEN 4 THEN '.mkv' WHEN 5 THEN '.txt' WHEN 6 THEN '' ELSE '.tar.MP4' END"""

TABLES = {
    "color_strings": """
SELECT p_partkey AS row_id, CASE p_partkey % 10
 WHEN 0 THEN printf('#%06X', (p_partkey*7919) % 16777216) WHEN 1 THEN printf('%06x', (p_partkey*104729) % 16777216)
 WHEN 2 THEN CAST(1000000+(p_partkey*7919) % 15000000 AS STRING) WHEN 3 THEN CAST((p_partkey*31) % 1000000 AS STRING)
 WHEN 4 THEN CAST(16777216+p_partkey AS STRING) WHEN 5 THEN p_brand WHEN 6 THEN '  #FfF ' WHEN 7 THEN ''
 WHEN 8 THEN CAST(-1-p_partkey AS STRING) ELSE CAST(NULL AS STRING) END AS color_text,
 (p_partkey*7919) % 20000000 - 1000000 AS color_int FROM part""",
    "color_parts": """
SELECT *, trim(coalesce(color_text, '')) AS t, regexp_matches(trim(coalesce(color_text, '')), '^#?[0-9a-fA-F]{1,6}$') AS is_hex
 FROM color_strings""",
    "color_values": """
SELECT *, CASE WHEN v BETWEEN 0 AND 16777215 THEN v END AS ok FROM
 (SELECT *, CASE WHEN is_hex THEN CAST('0x' || replace(t, '#', '') AS BIGINT) ELSE TRY_CAST(t AS BIGINT) END AS v FROM color_parts)""",
    "images": "SELECT s_suppkey AS image_id, CAST(s_nationkey AS BIGINT) AS batch_id, 24 AS width, 20 AS height FROM supplier",
    "pixels": """
SELECT CAST(s_nationkey AS BIGINT) AS batch_id, s_suppkey AS image_id, ny.n_nationkey AS y, nx.n_nationkey AS x,
 CAST((s_suppkey*37 + nx.n_nationkey*11 + ny.n_nationkey*5) % 256 AS INT) AS r,
 CAST((s_suppkey*53 + nx.n_nationkey*3 + ny.n_nationkey*ny.n_nationkey) % 256 AS INT) AS g,
 CAST((s_suppkey*71 + nx.n_nationkey*ny.n_nationkey) % 256 AS INT) AS b
 FROM supplier CROSS JOIN nation ny CROSS JOIN nation nx WHERE ny.n_nationkey < 20 AND nx.n_nationkey < 24""",
    "mask_pixels": """
SELECT CAST(s_nationkey AS BIGINT) AS batch_id, s_suppkey AS mask_idx, ny.n_nationkey AS y, nx.n_nationkey AS x,
 CASE WHEN s_nationkey % 7 = 0 OR nx.n_nationkey < 3 + s_nationkey % 5 OR nx.n_nationkey > 15 OR ny.n_nationkey < 2 OR ny.n_nationkey > 12 THEN 0.0::DOUBLE
  WHEN (s_nationkey*31 + s_suppkey*17 + nx.n_nationkey*7 + ny.n_nationkey*13) % 101 >= 95
  THEN ((s_nationkey*31 + s_suppkey*17 + nx.n_nationkey*7 + ny.n_nationkey*13) % 101)::DOUBLE / 100
  ELSE ((s_nationkey*31 + s_suppkey*17 + nx.n_nationkey*7 + ny.n_nationkey*13) % 101 % 51)::DOUBLE / 100 END AS m
 FROM supplier CROSS JOIN nation ny CROSS JOIN nation nx
 WHERE ny.n_nationkey < 20 AND nx.n_nationkey < 24 AND s_nationkey % 7 <> 1""",
    "united": "SELECT batch_id, y, x, bool_or(m > 0.5) AS selected FROM mask_pixels GROUP BY ALL",
    "full_masks": """
SELECT DISTINCT p.batch_id, p.y, p.x, coalesce(u.selected, true) AS selected
 FROM pixels p LEFT JOIN united u USING (batch_id, y, x)""",
    "boxes": """
SELECT batch_id, min(x) AS min_x, max(x) + 1 AS max_x, min(y) AS min_y, max(y) + 1 AS max_y
 FROM full_masks WHERE selected GROUP BY batch_id""",
    "windows": """
SELECT batch_id, CAST(min_x - 2 - 4 AS INT) AS start_x, CAST(min_y + 2 + 2 AS INT) AS start_y,
 CAST(greatest(1, max_x - min_x + 5) AS INT) AS win_width, CAST(greatest(1, max_y - min_y - 3) AS INT) AS win_height FROM boxes""",
    "canvases": """
SELECT i.batch_id, i.image_id, w.start_x, w.start_y, CAST(ty.v AS INT) AS y, CAST(tx.v AS INT) AS x
 FROM images i JOIN windows w USING (batch_id), range(0, 64) ty(v), range(0, 64) tx(v)
 WHERE ty.v < w.win_height AND tx.v < w.win_width""",
    "media_files": f"""
SELECT c_custkey AS file_id, concat('clip_', CAST(c_custkey AS STRING), {SUFFIX.format(id='c_custkey')}) AS name,
 (1700000000 + c_custkey*60)*1000 + (c_custkey*50) % 1000 AS mtime_ms FROM customer WHERE c_custkey % 9 <> 0""",
    "media_requests": "SELECT c_custkey AS request_id, concat('clip_', CAST(c_custkey AS STRING), '.mp4') AS name FROM customer",
    "frames": """
SELECT user_id AS video_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame_index,
 event_id % 211 <> 0 AS readable, concat(CAST(user_id AS STRING), '_', CAST(event_id AS STRING)) AS payload_text,
 64 + CAST(event_id % 5 AS INT) AS probe_width, 48 + CAST(event_id % 3 AS INT) AS probe_height FROM events""",
    "videos": """
SELECT user_id AS video_id, count(*) AS total_frames,
 CASE WHEN user_id % 11 = 0 THEN CAST(0 AS DOUBLE) WHEN user_id % 5 = 0 THEN CAST(24 AS DOUBLE) WHEN user_id % 5 = 1 THEN CAST(25 AS DOUBLE) WHEN user_id % 5 = 2 THEN CAST(2997 AS DOUBLE)/100 WHEN user_id % 5 = 3 THEN CAST(30 AS DOUBLE) ELSE CAST(60 AS DOUBLE) END AS original_fps,
 CAST(CASE WHEN user_id % 13 = 0 THEN 0 ELSE 320 + (user_id % 7)*160 END AS INT) AS width, CAST(CASE WHEN user_id % 13 = 0 THEN 0 ELSE 180 + (user_id % 5)*90 END AS INT) AS height
 FROM events GROUP BY user_id""",
    "video_params": """
SELECT DISTINCT user_id AS video_id, CAST(CASE user_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 12 WHEN 2 THEN 24 ELSE 10 END AS INT) AS framerate,
 CAST(CASE WHEN user_id % 3 = 0 THEN 0 ELSE 250 END AS INT) AS custom_width, CAST(CASE WHEN user_id % 2 = 0 THEN 0 ELSE 131 END AS INT) AS custom_height,
 (user_id % 4)*5 AS frame_load_cap, user_id % 7 AS skip_first_frames, 1 + user_id % 3 AS select_every_nth,
 CASE user_id % 5 WHEN 0 THEN 'abc' WHEN 1 THEN '-4' WHEN 2 THEN '500' WHEN 3 THEN CAST(NULL AS STRING) ELSE '32' END AS max_preview_text FROM events WHERE user_id % 17 <> 3""",
    "raw_params": """
SELECT event_id AS request_id,
 CASE event_id % 5 WHEN 0 THEN ' 24 ' WHEN 1 THEN '+12' WHEN 2 THEN '2.5' WHEN 3 THEN '-3' END AS framerate,
 CAST(event_id % 4000 - 100 AS STRING) AS custom_width, CASE event_id % 3 WHEN 0 THEN '1_080' WHEN 1 THEN '_7' ELSE '0720' END AS custom_height,
 CASE event_id % 4 WHEN 0 THEN '' ELSE CAST(event_id AS STRING) END AS frame_load_cap, CAST(-event_id AS STRING) AS skip_first_frames,
 CASE event_id % 2 WHEN 0 THEN '0' ELSE CAST(event_id % 9 AS STRING) END AS select_every_nth,
 CASE event_id % 5 WHEN 0 THEN 'abc' WHEN 1 THEN '-4' WHEN 2 THEN '500' WHEN 4 THEN '32' END AS max_preview_frames FROM events""",
    "good_frames": """
SELECT * FROM (SELECT *, bool_and(readable) OVER (PARTITION BY video_id ORDER BY frame_index) AS reached FROM frames) WHERE reached""",
    "plans": """
SELECT *, greatest(1, select_every_nth) * frame_step AS combined_step, CAST(CASE WHEN frame_step > 1 THEN 1 ELSE 0 END AS BIGINT) AS lead_in,
 skip_first_frames + CASE WHEN frame_step > 1 THEN 1 ELSE 0 END AS start_index
 FROM (SELECT *, CASE WHEN framerate <> 0 AND original_fps > 0
  THEN greatest(1, CAST(round_even(original_fps / framerate, 0) AS BIGINT)) ELSE CAST(1 AS BIGINT) END AS frame_step
  FROM loads)""",
    "loads": """
SELECT v.*, coalesce(p.framerate, 0) AS framerate, coalesce(p.custom_width, 0) AS custom_width, coalesce(p.custom_height, 0) AS custom_height,
 coalesce(p.frame_load_cap, 0) AS frame_load_cap, coalesce(p.skip_first_frames, 0) AS skip_first_frames, coalesce(p.select_every_nth, 1) AS select_every_nth,
 p.max_preview_text FROM videos v LEFT JOIN video_params p USING (video_id)""",
    "probed": """
SELECT v.video_id, CAST(CASE WHEN v.width > 0 AND v.height > 0 THEN v.width ELSE f.probe_width END AS INT) AS width,
 CAST(CASE WHEN v.width > 0 AND v.height > 0 THEN v.height ELSE f.probe_height END AS INT) AS height
 FROM videos v LEFT JOIN frames f ON f.video_id = v.video_id AND f.frame_index = 0 WHERE v.width > 0 AND v.height > 0 OR f.readable""",
    "picked": """
SELECT f.video_id, f.frame_index, f.payload_text, p.frame_load_cap, p.max_preview_text,
 row_number() OVER (PARTITION BY f.video_id ORDER BY f.frame_index) - 1 AS position
 FROM good_frames f JOIN plans p USING (video_id)
 WHERE f.frame_index >= start_index AND (f.frame_index - start_index) % combined_step = 0""",
    "capped": "SELECT * FROM picked WHERE frame_load_cap = 0 OR position < frame_load_cap",
    "previewed": """
SELECT * FROM capped WHERE position < CASE WHEN TRY_CAST(max_preview_text AS BIGINT) IS NULL THEN 48
 ELSE least(120, greatest(1, CAST(max_preview_text AS BIGINT))) END""",
    "speeds": """
SELECT *, (CASE WHEN framerate <> 0 THEN framerate ELSE trunc(original_fps) END)::DOUBLE / greatest(1, select_every_nth) AS fps FROM plans""",
    "stats": """
SELECT s.*, n.frame_count, n.first_index, n.last_index, greatest(CASE WHEN fps > 0 THEN 1000.0::DOUBLE / fps ELSE 100.0::DOUBLE END, 16.0::DOUBLE) AS duration_ms
 FROM speeds s JOIN (SELECT video_id, count(*) AS frame_count, min(frame_index) AS first_index, max(frame_index) AS last_index FROM capped GROUP BY 1) n USING (video_id)""",
    "sizes": """
SELECT video_id, CAST(floor(tw / 8.0::DOUBLE + 0.5) * 8 AS INT) AS target_width, CAST(floor(th / 8.0::DOUBLE + 0.5) * 8 AS INT) AS target_height FROM
 (SELECT video_id, CASE WHEN custom_width = 0 AND custom_height = 0 THEN width WHEN custom_height = 0 THEN custom_width
   WHEN custom_width = 0 THEN trunc(width * (custom_height::DOUBLE / nullif(height, 0)::DOUBLE)) ELSE custom_width END AS tw,
  CASE WHEN custom_width = 0 AND custom_height = 0 THEN height WHEN custom_width = 0 THEN custom_height
   WHEN custom_height = 0 THEN trunc(height * (custom_width::DOUBLE / nullif(width, 0)::DOUBLE)) ELSE custom_height END AS th
  FROM probed JOIN (SELECT video_id, custom_width, custom_height FROM loads) USING (video_id))""",
    "polygons": """
SELECT s_suppkey AS poly_id, r_regionkey AS nth,
 CAST(CASE r_regionkey WHEN 0 THEN 12 WHEN 1 THEN 18 WHEN 2 THEN 2 WHEN 3 THEN 22 ELSE 6 END + s_suppkey % 3 AS DOUBLE) + 0.3125 AS px,
 CAST(CASE r_regionkey WHEN 0 THEN 1 WHEN 1 THEN 17 WHEN 2 THEN 7 WHEN 3 THEN 6 ELSE 18 END AS DOUBLE) + 0.1875 AS py FROM supplier CROSS JOIN region""",
    "mask_events": """
SELECT event_id, ts, CASE WHEN event_id % 97 = 0 THEN CAST(NULL AS STRING) WHEN event_id % 89 = 0 THEN '' ELSE CAST(user_id AS STRING) END AS node_id,
 CASE WHEN event_id % 6 = 0 THEN CAST(NULL AS STRING) ELSE concat('clip_', CAST(user_id % 40 AS STRING), '.mp4') END AS video,
 CASE event_type WHEN 'error' THEN 'clear' WHEN 'click' THEN 'set' WHEN 'purchase' THEN 'set' ELSE 'param' END AS op,
 CASE WHEN event_type NOT IN ('click','purchase') THEN CAST(NULL AS STRING) WHEN event_id % 19 = 0 THEN '{}' WHEN event_id % 19 = 1 THEN '{"x":5,"width":40}'
  ELSE concat('{"x":', CAST(event_id % 700 - 50 AS STRING), ',"y":', CAST(event_id % 400 - 20 AS STRING), '.75,"width":', CAST(event_id % 300 AS STRING), ',"height":', CAST(event_id % 211 AS STRING), '}') END AS payload
 FROM events""",
    "sets": """
SELECT *, CASE WHEN payload = '{}' THEN NULL ELSE coalesce(CAST(trunc(CAST(payload ->> '$.x' AS DOUBLE)) AS BIGINT), 0) END AS x,
 CASE WHEN payload = '{}' THEN NULL ELSE coalesce(CAST(trunc(CAST(payload ->> '$.y' AS DOUBLE)) AS BIGINT), 0) END AS y,
 CASE WHEN payload = '{}' THEN NULL ELSE coalesce(CAST(payload ->> '$.width' AS BIGINT), 0) END AS width,
 CASE WHEN payload = '{}' THEN NULL ELSE coalesce(CAST(payload ->> '$.height' AS BIGINT), 0) END AS height
 FROM mask_events WHERE op = 'set'""",
    "last_writes": """
SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ts DESC, event_id DESC) AS n
 FROM mask_events WHERE op IN ('set', 'clear') AND node_id IS NOT NULL) WHERE n = 1""",
    "node_regions": """
SELECT node_id, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(s.width, 0) AS width, coalesce(s.height, 0) AS height
 FROM last_writes l JOIN sets s USING (event_id, node_id)""",
    "versions": "SELECT node_id, count(*) AS version FROM mask_events WHERE op IN ('set', 'clear') AND node_id <> '' GROUP BY 1",
    "named_videos": f"""
SELECT DISTINCT user_id AS video_id, concat('clip_', CAST(user_id AS STRING), {SUFFIX.format(id='user_id')}) AS name,
 CAST(user_id AS STRING) AS node_id FROM events""",
    "stamps": """
SELECT v.video_id, v.node_id, CASE WHEN f.name IS NULL THEN 'missing' ELSE CAST(f.mtime_ms // 1000 AS STRING) || '.' ||
  CASE WHEN f.mtime_ms % 1000 = 0 THEN '0' ELSE rtrim(lpad(CAST(f.mtime_ms % 1000 AS STRING), 3, '0'), '0') END END AS stamp
 FROM named_videos v LEFT JOIN media_files f USING (name)""",
    "prints": "SELECT video_id, stamp || '_' || CAST(coalesce(version, 0) AS STRING) AS fingerprint FROM stamps LEFT JOIN versions USING (node_id)",
    "video_masks": """
SELECT z.video_id, z.target_width, z.target_height, coalesce(q.mx, 0) AS mask_x, coalesce(q.my, 0) AS mask_y,
 coalesce(q.mw, 0) AS mask_width, coalesce(q.mh, 0) AS mask_height
 FROM sizes z LEFT JOIN (
  SELECT video_id, CAST(cx AS INT) AS mx, CAST(cy AS INT) AS my, CAST(cw AS INT) AS mw, CAST(ch AS INT) AS mh FROM
   (SELECT video_id, cx, cy, greatest(0, least(width, target_width - cx)) AS cw, greatest(0, least(height, target_height - cy)) AS ch FROM
    (SELECT z.*, r.width, r.height, greatest(0, least(r.x, z.target_width - 1)) AS cx, greatest(0, least(r.y, z.target_height - 1)) AS cy
     FROM sizes z JOIN node_regions r ON r.node_id = CAST(z.video_id AS STRING)))
  WHERE cw > 0 AND ch > 0) q USING (video_id)""",
    "frame_masks": "SELECT * FROM capped JOIN video_masks USING (video_id)",
    "sampled": "SELECT * FROM pixels WHERE x % 10 = 0 AND y % 10 = 0",
    "palettes": "SELECT DISTINCT batch_id, r, g, b FROM sampled",
    "hsv": """
SELECT *, CASE WHEN hi = 0 THEN 0.0::DOUBLE ELSE (hi - lo) / hi END AS s, hi AS v,
 CASE WHEN hi = lo THEN 0.0::DOUBLE WHEN hi = fr THEN (60.0::DOUBLE * ((fg - fb) / (hi - lo)) + 360.0::DOUBLE) % 360.0::DOUBLE
  WHEN hi = fg THEN (60.0::DOUBLE * ((fb - fr) / (hi - lo)) + 120.0::DOUBLE) % 360.0::DOUBLE
  ELSE (60.0::DOUBLE * ((fr - fg) / (hi - lo)) + 240.0::DOUBLE) % 360.0::DOUBLE END AS h
 FROM (SELECT *, greatest(fr, fg, fb) AS hi, least(fr, fg, fb) AS lo FROM
  (SELECT *, r / 255.0::DOUBLE AS fr, g / 255.0::DOUBLE AS fg, b / 255.0::DOUBLE AS fb FROM rgbs))""",
    "cube": """
SELECT r, g, b, r*65536 + g*256 + b AS value FROM
 (SELECT CAST(a.v AS INT) AS r, CAST(c.v AS INT) AS g, CAST(e.v AS INT) AS b FROM range(0, 141) a(v), range(0, 141) c(v), range(0, 141) e(v))
 WHERE greatest(r, g, b) / 255.0::DOUBLE * 255.0::DOUBLE <= 140 AND greatest(r, g, b) > 0
  AND (greatest(r, g, b) / 255.0::DOUBLE - least(r, g, b) / 255.0::DOUBLE) / (greatest(r, g, b) / 255.0::DOUBLE) BETWEEN 0.2::DOUBLE AND 0.6::DOUBLE""",
    # points of an 8-wide cell are within 6.1 of its middle, so a cell whose middle is 12.2 nearer than the best middle is out
    "middles": """
SELECT batch_id, cr, cg, cb, sqrt(min((cr*8+3.5-p.r)*(cr*8+3.5-p.r) + (cg*8+3.5-p.g)*(cg*8+3.5-p.g) + (cb*8+3.5-p.b)*(cb*8+3.5-p.b))) AS d
 FROM (SELECT DISTINCT r // 8 AS cr, g // 8 AS cg, b // 8 AS cb FROM cube), palettes p GROUP BY ALL""",
    "kept": "SELECT * FROM (SELECT *, max(d) OVER (PARTITION BY batch_id) AS top FROM middles) WHERE d + 12.2 >= top",
    "distances": """
SELECT p.batch_id, c.value, min((c.r-p.r)*(c.r-p.r) + (c.g-p.g)*(c.g-p.g) + (c.b-p.b)*(c.b-p.b)) AS d
 FROM kept k JOIN cube c ON c.r // 8 = cr AND c.g // 8 = cg AND c.b // 8 = cb JOIN palettes p ON p.batch_id = k.batch_id GROUP BY ALL""",
    "winners": """
SELECT batch_id, CAST(min(value) AS BIGINT) AS value, any_value(d) AS d FROM distances
 JOIN (SELECT batch_id, max(d) AS d FROM distances GROUP BY 1) USING (batch_id, d) GROUP BY batch_id""",
}

NEEDS = {
    "color_parts": ["color_strings"], "color_values": ["color_parts"], "united": ["mask_pixels"],
    "full_masks": ["pixels", "united"], "boxes": ["full_masks"], "windows": ["boxes"], "canvases": ["images", "windows"],
    "good_frames": ["frames"], "plans": ["loads"], "loads": ["videos", "video_params"], "probed": ["videos", "frames"], "picked": ["good_frames", "plans"], "capped": ["picked"],
    "previewed": ["capped"], "speeds": ["plans"], "stats": ["speeds", "capped"], "sizes": ["probed", "loads"],
    "sets": ["mask_events"], "last_writes": ["mask_events"], "node_regions": ["last_writes", "sets"], "versions": ["mask_events"],
    "stamps": ["named_videos", "media_files"], "prints": ["stamps", "versions"], "video_masks": ["sizes", "node_regions"],
    "frame_masks": ["capped", "video_masks"], "sampled": ["pixels"], "palettes": ["sampled"],
    "middles": ["cube", "palettes"], "kept": ["middles"], "distances": ["kept", "cube", "palettes"], "winners": ["distances"],
}
REPEATED = {"distances", "cube", "palettes", "canvases", "full_masks"}


def _with(names: str, body: str) -> str:
    """``body`` behind the derived tables it needs."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS.get(name, []):
            visit(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        visit(name)
    parts = [f"{n} AS {'MATERIALIZED ' if n in REPEATED else ''}({TABLES[n].strip()})" for n in order]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


def _hsv(names: str, rgbs: str, body: str) -> str:
    inner = f"rgbs AS ({rgbs.strip()}),\nhsv AS ({TABLES['hsv'].strip()})\n{body.strip()}"
    return _with(names, "SELECT 1").removesuffix("\nSELECT 1") + ",\n" + inner


def _color(channel: str, image: str, x: str, y: str) -> str:
    """Channel of a pixel, straight from its place."""
    return "CAST((" + {
        "r": f"{image}*37 + ({x})*11 + ({y})*5", "g": f"{image}*53 + ({x})*3 + ({y})*({y})", "b": f"{image}*71 + ({x})*({y})"}[channel] + ") % 256 AS INT)"


def _copied(only_masked: bool) -> str:
    """Output of cropping around the mask: every canvas position has the colour of its source position, if there is one."""
    inside = "sx BETWEEN 0 AND 23 AND sy BETWEEN 0 AND 19"
    fill = {"r": 16, "g": 32, "b": 48}
    if only_masked:
        source = """(SELECT c.batch_id, c.image_id, c.y, c.x, c.sx, c.sy, coalesce(k.selected, false) AS keep FROM
 (SELECT *, x + start_x AS sx, y + start_y AS sy FROM canvases) c LEFT JOIN full_masks k ON k.batch_id = c.batch_id AND k.y = c.sy AND k.x = c.sx)"""
    else:
        source = f"(SELECT *, {inside} AS keep FROM (SELECT *, x + start_x AS sx, y + start_y AS sy FROM canvases))"
    channels = ", ".join(f"CASE WHEN keep THEN {_color(c, 'image_id', 'sx', 'sy')} ELSE {fill[c]} END AS {c}" for c in "rgb")
    return _with("canvases pixels full_masks", f"""
SELECT batch_id, image_id, y, x, {channels} FROM {source}
UNION ALL
SELECT batch_id, image_id, y, x, r, g, b FROM pixels
 WHERE batch_id NOT IN (SELECT batch_id FROM full_masks WHERE selected)""")


TAP = "CASE WHEN abs(d) < 1e-6 THEN 1.0::DOUBLE ELSE sin(pi()*d) * sin(pi()*d/4) * 4 / (pi()*d*pi()*d) END"


def _axis(name: str, src: str, dst: str) -> str:
    """Integer tap weights for every distinct pair of sizes along one axis."""
    return f"""
{name} AS MATERIALIZED (SELECT src, dst, o, least(greatest(base - 3 + i, 0), src - 1) AS at,
 CAST(round_even(w / sum(w) OVER (PARTITION BY src, dst, o) * 2048, 0) AS BIGINT) AS w FROM
 (SELECT *, {TAP} AS w FROM
  (SELECT src, dst, o, base, i, CAST(CAST(f - CAST(base AS REAL) AS REAL) AS DOUBLE) + 3 - i AS d FROM
   (SELECT *, CAST(floor(f) AS INT) AS base FROM
    (SELECT src, dst, o, CAST((o + 0.5::DOUBLE) * (src::DOUBLE / dst) - 0.5::DOUBLE AS REAL) AS f FROM
     (SELECT DISTINCT {src} AS src, {dst} AS dst FROM targets), (SELECT CAST(v AS INT) AS o FROM range(0, 64) t(v)) WHERE o < dst)),
   (SELECT CAST(v AS INT) AS i FROM range(0, 8) t(v)))))"""


def _rotated(cos: float, sin: float) -> str:
    fixed = lambda v: f"CAST(floor({v!r}::DOUBLE * 65536 + 0.5) AS BIGINT)"
    start = lambda a, b, mid: (
        f"CAST(floor(({a!r}::DOUBLE * (-24/2.0::DOUBLE) + {b!r}::DOUBLE * (-20/2.0::DOUBLE) + {mid}/2.0::DOUBLE"
        f" + {a * 0.5!r}::DOUBLE + {b * 0.5!r}::DOUBLE) * 65536 + 0.5) AS BIGINT)")
    fill = {"r": 32, "g": 64, "b": 96}
    channels = ", ".join(
        f"CASE WHEN sx BETWEEN 0 AND 23 AND sy BETWEEN 0 AND 19 THEN {_color(c, 'image_id', 'sx', 'sy')} ELSE {fill[c]} END AS {c}" for c in "rgb")
    return _with("pixels", f"""
SELECT batch_id, image_id, y, x, {channels}
 FROM (SELECT batch_id, image_id, y, x, ({start(cos, sin, '24')} + x*{fixed(cos)} + y*{fixed(sin)}) >> 16 AS sx,
  ({start(-sin, cos, '20')} + x*{fixed(-sin)} + y*{fixed(cos)}) >> 16 AS sy FROM pixels) t""")


def _param(name: str, default: int, low: int, high: int | None = None) -> str:
    text = f"trim({name})"
    number = f"CASE WHEN regexp_full_match({text}, '[+-]?[0-9]+(_[0-9]+)*') THEN CAST(replace({text}, '_', '') AS BIGINT) END"
    value = f"greatest({low}, coalesce({number}, {default}))"
    return f"CAST({f'least({high}, {value})' if high else value} AS BIGINT) AS {name}"


LASSO = """
SELECT poly_id, y, x FROM
 (SELECT e.poly_id, CAST(a.v AS INT) AS y, CAST(c.v AS INT) AS x,
   sum(CASE WHEN y1 <= a.v + 0.5 AND a.v + 0.5 < y2 AND (x2-x1)*(a.v + 0.5 - y1) - (c.v + 0.5 - x1)*(y2-y1) > 0 THEN 1
            WHEN y2 <= a.v + 0.5 AND a.v + 0.5 < y1 AND (x2-x1)*(a.v + 0.5 - y1) - (c.v + 0.5 - x1)*(y2-y1) < 0 THEN -1 ELSE 0 END) AS winding
  FROM (SELECT p.poly_id, p.px AS x1, p.py AS y1, q.px AS x2, q.py AS y2 FROM polygons p JOIN polygons q ON q.poly_id = p.poly_id AND q.nth = (p.nth + 1) % 5) e,
   range(0, 20) a(v), range(0, 24) c(v) GROUP BY ALL) WHERE winding <> 0"""

ORACLES = {
    # sources and sinks
    "media_catalog": _with("media_files", """
SELECT file_id, name, mtime_ms FROM media_files WHERE lower(split_part(name, '.', -1)) IN ('webm', 'mp4', 'mkv', 'gif', 'mov')"""),
    "missing_media": _with("media_files media_requests", """
SELECT request_id, name, 'Invalid video file: ' || name AS message FROM media_requests WHERE name NOT IN (SELECT name FROM media_files)"""),
    "image_pixels": _with("pixels", "SELECT batch_id, image_id, y, x, r, g, b FROM pixels"),
    "frame_sink_manifest": _with("capped", """
SELECT video_id, position, frame_index, printf('vme_frame_%s_%04d.png', CAST(video_id AS STRING), position) AS file_name FROM capped"""),
    "preview_manifest": _with("previewed speeds sizes", """
SELECT video_id, string_agg(CAST(frame_index AS STRING), ',' ORDER BY frame_index) AS selected_frame_indices,
 string_agg(to_base64(encode(payload_text)), ',' ORDER BY frame_index) AS frame_data, count(*) AS n_frames,
 round(any_value(fps), 6) AS fps, CAST(trunc(any_value(original_fps)) AS BIGINT) AS original_fps, any_value(total_frames) AS frame_count,
 '{"frames":[' || string_agg('{"index":' || position || ',"data":"' || to_base64(encode(payload_text)) || '","width":' || target_width
  || ',"height":' || target_height || '}', ',' ORDER BY frame_index) || '],"fps":' || any_value(fps) || ',"original_fps":'
  || CAST(trunc(any_value(original_fps)) AS BIGINT) || ',"selected_frame_indices":[' || string_agg(CAST(frame_index AS STRING), ',' ORDER BY frame_index)
  || '],"frame_count":' || any_value(total_frames) || '}' AS document
 FROM previewed JOIN speeds USING (video_id) JOIN sizes USING (video_id) GROUP BY video_id"""),
    "preview_failures": _with("videos probed previewed", """
SELECT video_id, 'Could not read video frame to determine dimensions' AS error FROM videos WHERE video_id NOT IN (SELECT video_id FROM probed)
UNION ALL SELECT video_id, 'No frames loaded from video' FROM probed WHERE video_id NOT IN (SELECT video_id FROM previewed)"""),
    # colour columns
    "color_standardize": _with("color_values", """
SELECT row_id, coalesce(ok, 0) AS value, CASE WHEN ok IS NULL THEN 'Invalid' ELSE printf('#%06X', ok) END AS hex,
 CASE WHEN ok IS NULL THEN '0, 0, 0' ELSE printf('%d, %d, %d', ok // 65536, ok // 256 % 256, ok % 256) END AS rgb FROM color_values"""),
    "color_reject_report": _with("color_values", """
SELECT CASE WHEN ok IS NULL THEN 'invalid' WHEN is_hex THEN 'hex' ELSE 'decimal' END AS path, count(*) AS n_rows FROM color_values GROUP BY 1"""),
    "color_rejects": _with("color_values", "SELECT row_id, color_text FROM color_values WHERE ok IS NULL"),
    "hex_to_rgb": _with("color_parts", """
SELECT row_id, CAST(CASE WHEN is_hex THEN h // 65536 ELSE 0 END AS INT) AS r, CAST(CASE WHEN is_hex THEN h // 256 % 256 ELSE 0 END AS INT) AS g,
 CAST(CASE WHEN is_hex THEN h % 256 ELSE 0 END AS INT) AS b FROM
 (SELECT *, CASE WHEN is_hex THEN CAST('0x' || replace(t, '#', '') AS BIGINT) END AS h FROM color_parts)"""),
    "pack_rgb24": _with("pixels", "SELECT image_id, y, x, CAST(r AS BIGINT)*65536 + g*256 + b AS value FROM pixels"),
    "unpack_rgb24": _with("color_strings", """
SELECT row_id, CASE WHEN k THEN CAST(color_int // 65536 AS INT) END AS r, CASE WHEN k THEN CAST(color_int // 256 % 256 AS INT) END AS g,
 CASE WHEN k THEN CAST(color_int % 256 AS INT) END AS b FROM (SELECT *, color_int BETWEEN 0 AND 16777215 AS k FROM color_strings)"""),
    "range24_filter": _with("color_strings", "SELECT row_id, color_int FROM color_strings WHERE color_int BETWEEN 0 AND 16777215"),
    "format_color": _with("color_strings", """
SELECT row_id, color_int, printf('#%06X', color_int) AS hex, printf('%d, %d, %d', color_int // 65536, color_int // 256 % 256, color_int % 256) AS rgb
 FROM color_strings WHERE color_int BETWEEN 0 AND 16777215"""),
    "rgb_to_hsv": _hsv("pixels", "SELECT * FROM pixels", "SELECT image_id, y, x, round(h, 6) AS h, round(s, 6) AS s, round(v, 6) AS v FROM hsv"),
    # palettes
    "pixel_grid_sample": _with("sampled", "SELECT * FROM sampled"),
    "distinct_palette": _with("pixels", "SELECT batch_id, r, g, b, count(*) AS n_pixels FROM pixels GROUP BY ALL"),
    "muted_color_filter": _hsv("pixels", "SELECT batch_id, r, g, b, count(*) AS n_pixels FROM pixels GROUP BY ALL", """
SELECT batch_id, r, g, b, n_pixels FROM hsv WHERE v * 255.0::DOUBLE <= 140 AND s BETWEEN 0.2::DOUBLE AND 0.6::DOUBLE"""),
    "nearest_palette_color": _with("pixels palettes", """
SELECT batch_id, value, CAST(d % 16777216 AS BIGINT) AS nearest_value, round(sqrt(d // 16777216), 6) AS distance FROM
 (SELECT batch_id, CAST(q.r AS BIGINT)*65536 + q.g*256 + q.b AS value,
  min(CAST((q.r-p.r)*(q.r-p.r) + (q.g-p.g)*(q.g-p.g) + (q.b-p.b)*(q.b-p.b) AS BIGINT)*16777216 + p.r*65536 + p.g*256 + p.b) AS d
  FROM (SELECT DISTINCT batch_id, r, g, b FROM pixels) q JOIN palettes p USING (batch_id) GROUP BY ALL)"""),
    "farthest_color": _with("winners", """
SELECT batch_id, value, printf('#%06X', value) AS hex, printf('%d, %d, %d', value // 65536, value // 256 % 256, value % 256) AS rgb FROM winners"""),
    "farthest_color_fallback": _with("images", """
SELECT DISTINCT batch_id, CAST(80*65536 + 100*256 + 90 AS BIGINT) AS value, '#50645A' AS hex, '80, 100, 90' AS rgb FROM images"""),
    "farthest_color_summary": _hsv("winners", """
SELECT batch_id, CAST(value // 65536 AS INT) AS r, CAST(value // 256 % 256 AS INT) AS g, CAST(value % 256 AS INT) AS b, d FROM winners""", """
SELECT batch_id, r, g, b, round(h, 6) AS h, round(s, 6) AS s, round(v, 6) AS v, round(sqrt(d), 6) AS distance FROM hsv"""),
    # geometry
    "rotate_pixels": _rotated(0.866025403784439, 0.5),
    "fit_to_size": _with("images pixels", """
SELECT t.batch_id, t.image_id, t.y, t.x, CAST(coalesce(p.r, 16) AS INT) AS r, CAST(coalesce(p.g, 32) AS INT) AS g, CAST(coalesce(p.b, 48) AS INT) AS b FROM
 (SELECT batch_id, image_id, CAST(a.v AS INT) AS y, CAST(c.v AS INT) AS x FROM images, range(0, 13) a(v), range(0, 31) c(v)) t
 LEFT JOIN pixels p ON p.image_id = t.image_id AND p.x = t.x - 3 AND p.y = t.y + 4"""),
    "mask_union": _with("united", "SELECT * FROM united"),
    "mask_runs": _with("united", """
SELECT batch_id, y, CAST(min(x) AS INT) AS x_from, CAST(max(x) + 1 AS INT) AS x_to FROM
 (SELECT *, x - row_number() OVER (PARTITION BY batch_id, y ORDER BY x) AS island FROM united WHERE selected) GROUP BY batch_id, y, island
UNION ALL SELECT batch_id, 0, 0, 0 FROM united GROUP BY batch_id HAVING NOT bool_or(selected)"""),
    "mask_default_full": _with("full_masks", "SELECT * FROM full_masks"),
    "mask_bbox": _with("united", """
SELECT batch_id, min(x) AS min_x, max(x) + 1 AS max_x, min(y) AS min_y, max(y) + 1 AS max_y FROM united WHERE selected GROUP BY batch_id"""),
    "empty_mask_passthrough": _with("pixels united", """
SELECT batch_id, image_id, y, x, r, g, b FROM pixels WHERE batch_id IN (SELECT batch_id FROM united GROUP BY 1 HAVING NOT bool_or(selected))"""),
    "pose_window": _with("windows", "SELECT * FROM windows"),
    "pose_crop_fill": _copied(False),
    "pose_only_fill": _copied(True),
    "fill_channels": _with("pixels", """
SELECT image_id, y, x, n AS n_channels, CASE n WHEN 1 THEN r::STRING WHEN 2 THEN concat(r, ',', g) WHEN 3 THEN concat(r, ',', g, ',', b)
 WHEN 4 THEN concat(r, ',', g, ',', b, ',', b) ELSE concat(r, ',', g, ',', b, ',', b, ',', b) END AS fill
 FROM (SELECT *, CAST(1 + image_id % 5 AS INT) AS n FROM pixels)"""),
    "quantize_pixels": _with("mask_pixels", """
SELECT batch_id, mask_idx, y, x, level, round(CAST(CAST(level AS REAL) / 255::REAL AS DOUBLE), 6) AS back FROM
 (SELECT *, CAST(trunc(CAST(m AS REAL) * 255::REAL) AS INT) AS level FROM mask_pixels)"""),
    "resize_pixels": _with("images pixels", "SELECT 1").removesuffix("\nSELECT 1") + """,
targets AS MATERIALIZED (SELECT batch_id, image_id, width AS sw, height AS sh, CASE image_id % 4 WHEN 0 THEN 24 WHEN 1 THEN 16 WHEN 2 THEN 32 ELSE 24 END AS tw,
 CASE image_id % 4 WHEN 0 THEN 20 WHEN 1 THEN 16 WHEN 2 THEN 24 ELSE 8 END AS th FROM images),""" + _axis("across", "sw", "tw") + "," + _axis("down", "sh", "th") + """,
wide AS MATERIALIZED (SELECT t.batch_id, t.image_id, t.sh, t.th, p.y, a.o AS x, sum(p.r*a.w) AS r, sum(p.g*a.w) AS g, sum(p.b*a.w) AS b
 FROM pixels p JOIN targets t ON t.image_id = p.image_id AND (t.sw <> t.tw OR t.sh <> t.th) JOIN across a ON a.src = t.sw AND a.dst = t.tw AND a.at = p.x GROUP BY ALL)
SELECT w.batch_id, w.image_id, d.o AS y, w.x,
 CAST(least(255, greatest(0, (sum(w.r*d.w) + 2097152) >> 22)) AS INT) AS r, CAST(least(255, greatest(0, (sum(w.g*d.w) + 2097152) >> 22)) AS INT) AS g,
 CAST(least(255, greatest(0, (sum(w.b*d.w) + 2097152) >> 22)) AS INT) AS b
 FROM wide w JOIN down d ON d.src = w.sh AND d.dst = w.th AND d.at = w.y GROUP BY ALL
UNION ALL SELECT p.batch_id, p.image_id, p.y, p.x, p.r, p.g, p.b FROM pixels p JOIN targets t USING (image_id) WHERE t.sw = t.tw AND t.sh = t.th""",
    "lasso_mask": _with("polygons", LASSO),
    "lasso_stroke": _with("polygons", LASSO + """
UNION SELECT poly_id, y, x FROM (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (((x + 0.5) - x1)*dx + ((y + 0.5) - y1)*dy) / (dx*dx + dy*dy))) AS t FROM
 (SELECT p.poly_id, p.px AS x1, p.py AS y1, q.px - p.px AS dx, q.py - p.py AS dy, CAST(a.v AS INT) AS y, CAST(c.v AS INT) AS x
  FROM polygons p JOIN polygons q USING (poly_id), range(0, 20) a(v), range(0, 24) c(v) WHERE p.nth = 4 AND q.nth = 0))
 WHERE pow((x + 0.5) - (x1 + t*dx), 2) + pow((y + 0.5) - (y1 + t*dy), 2) <= 3.0625"""),
    # frame sequences
    "readable_prefix": _with("good_frames", "SELECT video_id, frame_index, payload_text FROM good_frames"),
    "target_size": _with("sizes", "SELECT *, target_width = 0 OR target_height = 0 AS vanished FROM sizes"),
    "probe_dimensions": _with("videos frames", """
SELECT v.video_id, CAST(CASE WHEN v.width > 0 AND v.height > 0 THEN v.width WHEN f.readable THEN f.probe_width END AS INT) AS width,
 CAST(CASE WHEN v.width > 0 AND v.height > 0 THEN v.height WHEN f.readable THEN f.probe_height END AS INT) AS height,
 CASE WHEN (v.width <= 0 OR v.height <= 0) AND NOT f.readable THEN 'Could not read video frame to determine dimensions' END AS error
 FROM videos v LEFT JOIN frames f ON f.video_id = v.video_id AND f.frame_index = 0"""),
    "sampling_plan": _with("plans", "SELECT video_id, frame_step, combined_step, lead_in, start_index FROM plans"),
    "select_frames": _with("picked", "SELECT video_id, frame_index, position, payload_text FROM picked"),
    "frame_cap": _with("capped", "SELECT video_id, frame_index, position FROM capped"),
    "preview_frames": _with("previewed", "SELECT video_id, frame_index, position FROM previewed"),
    "bgr_to_rgb": _with("pixels", "SELECT batch_id, image_id, y, x, b AS r, g, r AS b FROM pixels"),
    "sequence_stats": _with("stats", """
SELECT video_id, frame_count, first_index, last_index, round(fps, 6) AS effective_fps, CAST(trunc(original_fps) AS BIGINT) AS original_fps,
 total_frames, frame_step, combined_step FROM stats"""),
    "empty_selection_report": _with("plans capped", """
SELECT video_id, 'No frames loaded from video' AS error FROM plans WHERE video_id NOT IN (SELECT video_id FROM capped)"""),
    "frame_lookup": _with("frames", """
SELECT request_id, q.video_id, n, f.payload_text FROM (SELECT event_id AS request_id, user_id AS video_id, event_id % 97 - 7 AS n FROM events) q
 LEFT JOIN frames f ON f.video_id = q.video_id AND f.frame_index = greatest(0, n) AND f.readable"""),
    "frame_timeline": _with("capped stats", """
SELECT video_id, frame_index, position, round(duration_ms, 6) AS duration_ms, round(position * duration_ms, 6) AS start_ms,
 round((position + 1) * duration_ms, 6) AS end_ms FROM capped JOIN stats USING (video_id)"""),
    "frame_at_time": _with("capped stats", """
SELECT probe_id, q.video_id, c.position, c.frame_index FROM
 (SELECT event_id AS probe_id, user_id AS video_id, CAST((event_id*37) % 100000 AS DOUBLE) AS at_ms FROM events) q
 JOIN stats s USING (video_id) JOIN capped c ON c.video_id = q.video_id AND c.position = CAST(floor(at_ms / duration_ms) AS BIGINT) % frame_count"""),
    "wan_frames": _with("stats", """
SELECT video_id, frame_count, wan_frames, wan_frames - frame_count AS pad_frames FROM
 (SELECT video_id, frame_count, CASE WHEN frame_count <= 1 THEN 1 ELSE 1 + (frame_count - 1 + 3) // 4 * 4 END AS wan_frames FROM stats)"""),
    "load_params_clean": _with("raw_params", "SELECT request_id, " + ", ".join([
        _param("framerate", 0, 0), _param("custom_width", 0, 0), _param("custom_height", 0, 0), _param("frame_load_cap", 0, 0),
        _param("skip_first_frames", 0, 0), _param("select_every_nth", 1, 1), _param("max_preview_frames", 48, 1, 120),
    ]) + " FROM raw_params"),
    # region masks
    "region_from_json": _with("sets", "SELECT event_id, x, y, width, height FROM sets"),
    "clamp_region": _with("sets probed", """
SELECT event_id, frame_width, frame_height, CAST(cx AS BIGINT) AS x, CAST(cy AS BIGINT) AS y,
 CASE WHEN cx IS NOT NULL THEN CAST(greatest(0, least(w, frame_width - cx)) AS BIGINT) END AS width,
 CASE WHEN cx IS NOT NULL THEN CAST(greatest(0, least(h, frame_height - cy)) AS BIGINT) END AS height FROM
 (SELECT event_id, v.width AS frame_width, v.height AS frame_height, s.width AS w, s.height AS h,
  CASE WHEN s.x IS NOT NULL THEN greatest(0, least(s.x, v.width - 1)) END AS cx, CASE WHEN s.y IS NOT NULL THEN greatest(0, least(s.y, v.height - 1)) END AS cy
  FROM sets s JOIN probed v ON CAST(v.video_id AS STRING) = s.node_id)"""),
    "region_mask": _with("frame_masks", """
SELECT video_id, frame_index, target_width, target_height, mask_x, mask_y, mask_width, mask_height FROM frame_masks"""),
    "region_mask_lines": _with("video_masks", """
SELECT video_id, CAST(t.v AS INT) AS y, CASE WHEN t.v >= mask_y AND t.v < mask_y + mask_height THEN mask_x ELSE 0 END AS x_from,
 CASE WHEN t.v >= mask_y AND t.v < mask_y + mask_height THEN mask_x + mask_width ELSE 0 END AS x_to, target_width
 FROM video_masks, range(0, 8192) t(v) WHERE t.v < target_height"""),
    "region_crop": _with("pixels images node_regions", """
SELECT p.batch_id, p.image_id, CAST(p.y - coalesce(k.cy, 0) AS INT) AS y, CAST(p.x - coalesce(k.cx, 0) AS INT) AS x, p.r, p.g, p.b FROM pixels p LEFT JOIN
 (SELECT * FROM (SELECT image_id, cx, cy, least(w, 24 - cx) AS cw, least(h, 20 - cy) AS ch FROM
  (SELECT i.image_id, n.width AS w, n.height AS h, greatest(0, least(n.x, 23)) AS cx, greatest(0, least(n.y, 19)) AS cy
   FROM images i JOIN node_regions n ON n.node_id = CAST(i.image_id AS STRING))) WHERE cw > 0 AND ch > 0) k USING (image_id)
 WHERE k.cx IS NULL OR (p.x >= k.cx AND p.x < k.cx + k.cw AND p.y >= k.cy AND p.y < k.cy + k.ch)"""),
    "crop_mask": _with("images node_regions", """
SELECT image_id, CAST(cw AS INT) AS target_width, CAST(ch AS INT) AS target_height, 0 AS mask_x, 0 AS mask_y, CAST(cw AS INT) AS mask_width,
 CAST(ch AS INT) AS mask_height FROM (SELECT image_id, least(w, 24 - cx) AS cw, least(h, 20 - cy) AS ch FROM
  (SELECT i.image_id, n.width AS w, n.height AS h, greatest(0, least(n.x, 23)) AS cx, greatest(0, least(n.y, 19)) AS cy
   FROM images i JOIN node_regions n ON n.node_id = CAST(i.image_id AS STRING))) WHERE cw > 0 AND ch > 0"""),
    "mask_coverage": _with("frame_masks", """
SELECT video_id, count(*) AS n_frames, CAST(sum(CAST(mask_width AS BIGINT) * mask_height) AS BIGINT) AS ones,
 round(coalesce(sum(mask_width * mask_height)::DOUBLE / nullif(sum(target_width * target_height), 0)::DOUBLE, 0), 6) AS coverage FROM frame_masks GROUP BY 1"""),
    # mask-region log
    "latest_region_by_node": _with("node_regions", "SELECT * FROM node_regions"),
    "latest_region_by_video": _with("sets", """
SELECT video, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(width, 0) AS width, coalesce(height, 0) AS height FROM
 (SELECT *, row_number() OVER (PARTITION BY video ORDER BY ts DESC, event_id DESC) AS n FROM sets WHERE node_id IS NOT NULL AND video <> '') WHERE n = 1"""),
    "mask_version": _with("versions", "SELECT * FROM versions"),
    "change_fingerprint": _with("prints", "SELECT * FROM prints"),
    "stale_videos": _with("prints", """
SELECT video_id, fingerprint, previous FROM prints JOIN
 (SELECT video_id, stamp || '_' || CAST(coalesce(n, 0) AS STRING) AS previous FROM stamps LEFT JOIN
  (SELECT node_id, count(*) AS n FROM mask_events WHERE op IN ('set', 'clear') AND node_id <> '' AND ts < TIMESTAMP '2024-01-16' GROUP BY 1) USING (node_id))
 USING (video_id) WHERE fingerprint <> previous"""),
    "stream_mask_state": _with("last_writes sets versions", """
SELECT node_id, l.op, coalesce(version, 0) AS version, CASE WHEN l.op = 'set' THEN coalesce(s.x, 0) END AS x, CASE WHEN l.op = 'set' THEN coalesce(s.y, 0) END AS y,
 CASE WHEN l.op = 'set' THEN coalesce(s.width, 0) END AS width, CASE WHEN l.op = 'set' THEN coalesce(s.height, 0) END AS height
 FROM last_writes l LEFT JOIN versions USING (node_id) LEFT JOIN sets s USING (event_id, node_id)"""),
    "debounce_changes": _with("mask_events", """
SELECT node_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, video FROM
 (SELECT *, lead(ts) OVER (PARTITION BY node_id ORDER BY ts, event_id) AS next_ts FROM mask_events WHERE op = 'param' AND node_id IS NOT NULL)
 WHERE next_ts IS NULL OR next_ts >= ts + INTERVAL 6 HOURS"""),
    "debounce_stream": _with("mask_events", """
SELECT node_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, video FROM
 (SELECT *, lead(ts) OVER (PARTITION BY node_id ORDER BY ts, event_id) AS next_ts FROM mask_events WHERE op = 'param' AND node_id IS NOT NULL)
 WHERE next_ts IS NULL OR next_ts >= ts + INTERVAL 6 HOURS"""),
    "stream_new_media": _with("media_files", """
SELECT file_id, name, mtime_ms FROM media_files WHERE lower(split_part(name, '.', -1)) IN ('webm', 'mp4', 'mkv', 'gif', 'mov')"""),
}
#: The same answers by another way.
ORACLES |= {name: ORACLES[plain] for name, plain in {
    "mask_union_runs": "mask_union", "pose_only_fill_runs": "pose_only_fill", "tiled_pose_crop": "pose_crop_fill", "tiled_region_crop": "region_crop",
    "debounce_timer_stream": "debounce_changes", "stored_frame_cap": "frame_cap", "stored_preview_frames": "preview_frames",
}.items()}
