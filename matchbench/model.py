"""Schemas of the tables that stages exchange."""

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "boolean": T.BooleanType()}
#: Column and type, in the manifest's order.
MANIFEST = T.StructType([
    T.StructField(*f.split()[:1], _TYPES[f.split()[1]])
    for f in (
        "dataset string, subject_id string, sample_id string, session string, path_2d string, path_3d string, path_landmarks string, "
        "expression string, pose_yaw double, pose_pitch double, illumination string, occlusion string, orig_w int, orig_h int, n_points int, "
        "has_2d boolean, has_3d boolean, detect_ok boolean, align_ok boolean, nosetip_ok boolean, quality_flag string, notes string, data_modality string"
    ).split(", ")
])
#: Similarities are compared across engines and runs, so scores are rounded to this many decimals before they are ranked or grouped.
SCORE_DECIMALS = 9
ILLUMINATIONS = ("normal", "strong", "dark", "side", "NA")
ILLUMINATION_PREFIXES = ("yale:", "synthetic:")
MODALITIES = ("real", "synthetic_toy")
#: Rows of a side that may be sent to every executor as one matrix; beyond it sides are dealt in blocks.
BROADCAST_ROWS = 100_000
#: And its bytes at most, as doubles.
BROADCAST_BYTES = 64 << 20
