"""Views over the test tables that look like scored images: boxes, frames, readings.

Each view is a list of expressions over its source, the same for Spark and DuckDB but for
three words that differ between the dialects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPARK = {"json": "get_json_object(props, '$.k')", "div": "event_id div 6", "str": "STRING"}
DUCK = {"json": "json_extract_string(props, '$.k')", "div": "event_id // 6", "str": "VARCHAR"}

#: name: (source, expressions, condition)
VIEWS = {
    "ev": (
        "events",
        "event_id; user_id; ts; value; event_type; CAST({json} AS INT) AS k; {div} AS image_id; CAST(event_id % 6 AS INT) AS slot",
        "",
    ),
    "fx_vehicle": (
        "ev",
        "image_id; event_id AS vehicle_id; CASE WHEN k%11=0 THEN 'unknown' WHEN k%4=0 THEN 'bus' WHEN k%4=1 THEN 'truck'"
        " WHEN k%4=2 THEN 'motorcycle' ELSE 'car' END AS vehicle_type; (30+k%70)/1e2 AS confidence;"
        " slot*180+k%40 AS x1; 20 AS y1; slot*180+k%40+180 AS x2; 220 AS y2",
        "slot < 3",
    ),
    "fx_plate": (
        "ev",
        "image_id; event_id AS plate_id; (k*7+CAST(user_id AS INT)*13)%560 AS x1; 40+(k*3)%120 AS y1;"
        " (k*7+CAST(user_id AS INT)*13)%560+40 AS x2; 40+(k*3)%120+14 AS y2; (50+k%50)/1e2 AS confidence",
        "slot >= 3",
    ),
    "fx_observation": (
        "ev",
        "event_id AS frame_idx; user_id AS track_id; value AS sharpness; (50+(user_id%5)*7+k%20)/1e2 AS ocr_confidence;"
        " CASE WHEN user_id%7=0 THEN 7e-1 ELSE 1e0 END AS format_score;"
        " concat('KA01AB', lpad(CAST((user_id*7)%10000 + CASE WHEN user_id%3=0 AND k%2=0 THEN 1"
        " WHEN user_id%3<>0 AND k%5=0 THEN 1 ELSE 0 END AS {str}), 4, '0')) AS proposed_text",
        "",
    ),
    "fx_frame": ("ev", "ts; event_id AS frame_idx; user_id AS track_id; value AS sharpness", ""),
    "fx_layout": (
        "ev",
        "event_id; CASE k%7 WHEN 0 THEN concat('KA01A', lpad(CAST(user_id%1000 AS {str}), 3, '0')) WHEN 1 THEN concat('KA01A', lpad(CAST(user_id%100 AS {str}), 2, '0'))"
        " WHEN 2 THEN concat('KA0IAB', lpad(CAST(user_id%10000 AS {str}), 4, '0')) WHEN 3 THEN concat('MH1A', lpad(CAST(user_id%10000 AS {str}), 4, '0'))"
        " WHEN 4 THEN concat('DL1CA', lpad(CAST(user_id%10000 AS {str}), 4, '0')) WHEN 5 THEN concat('KA', lpad(CAST(user_id AS {str}), 6, '0'))"
        " ELSE concat('8H12A', lpad(CAST(user_id%10000 AS {str}), 4, 'O')) END AS text",
        "",
    ),
    "fx_truth": (
        "fx_plate",
        "image_id; plate_id AS target_id; x1+plate_id%9 AS x1; y1+plate_id%4 AS y1; x2+plate_id%9 AS x2; y2+plate_id%4 AS y2;"
        " concat('MH12AB', lpad(CAST(plate_id%10000 AS {str}), 4, '0')) AS text",
        "plate_id%7 <> 0",
    ),
    "fx_pair": ("fx_plate", "image_id; plate_id; confidence; {each} AS ord", ""),
    "fx_reading": (
        "fx_pair",
        "image_id; plate_id; ord; CASE WHEN ord=0 THEN 'original' ELSE 'restored' END AS ocr_source;"
        " concat('MH12AB', lpad(CAST((plate_id + CASE WHEN ord=1 AND plate_id%4=0 THEN 1 ELSE 0 END)%10000 AS {str}), 4, '0')) AS proposed_text;"
        " confidence - ord*((plate_id%5)*3e-2) AS selection_score; confidence AS ocr_confidence;"
        " CASE WHEN confidence - ord*((plate_id%5)*3e-2) >= 0.8e0 THEN 'accepted' ELSE 'uncertain' END AS status",
        "",
    ),
    "fx_image": ("documents", "doc_id AS image_id; source; lang AS condition; CAST(n_chars%3 AS {str}) AS severity; text", ""),
    "fx_region": (
        "ev",
        "image_id; event_id AS region_id; slot AS ord; (40+k%61)/1e2 AS conf;"
        " CASE slot WHEN 0 THEN 'IND' WHEN 1 THEN CASE k%3 WHEN 0 THEN 'ka-01' WHEN 1 THEN 'KAO1' ELSE 'MH12' END"
        " WHEN 2 THEN CASE k%4 WHEN 0 THEN 'AB' WHEN 1 THEN 'A8' ELSE 'XY' END"
        " WHEN 3 THEN lpad(CAST(user_id*k%10000 AS {str}), 4, '0') WHEN 4 THEN CASE k%5 WHEN 0 THEN 'Q1' ELSE '' END ELSE 'x' END AS text;"
        " CAST((slot*37+k)%200 AS DOUBLE) AS x1; CAST((slot%2)*30+k%9 AS DOUBLE) AS y1;"
        " CAST((slot*37+k)%200+30 AS DOUBLE) AS x2; CAST((slot%2)*30+k%9+20 AS DOUBLE) AS y2",
        "slot < 5",
    ),
}
SPARK["each"], DUCK["each"] = "explode(array(0, 1))", "unnest([0, 1])"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view, or the table of that name, as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    source, exprs, condition = VIEWS[name]
    df = view(spark, sf_dir, source)
    if condition:
        df = df.where(F.expr(condition))
    return df.selectExpr(*(e.format(**SPARK) for e in exprs.split(";")))


def duck(*names: str) -> str:
    """``WITH`` clause that defines views and what they rest on, for DuckDB."""
    need: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in need:
            add(VIEWS[name][0])
            need.append(name)

    for name in names:
        add(name)
    parts = []
    for name in need:
        source, exprs, condition = VIEWS[name]
        parts.append(f"{name} AS (SELECT {exprs.replace(';', ',').format(**DUCK)} FROM {source}" + (f" WHERE {condition})" if condition else ")"))
    return "WITH RECURSIVE " + ",\n".join(parts)
