"""Labelled dataset building.

Re-aims the per-device traffic dataset builder as one Spark scan: every CSV
under ``<root>/<device>/`` is read in a single multi-path ``spark.read.csv``
(U1); device and attack come from the file path (D5); class names get codes
by position in fixed lists (P7); the feature width is checked (P8); and the
train/test split is a hash of the row's content, so the label stays on its
row (fixes the reference's label/row misalignment) and the split does not
depend on file order or partitioning (T5, U4).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nnspark.functions.hashing import md5_uniform
from nnspark.functions.text import label_from_file

# Class vocabularies of the traffic dataset, in code order.
ATTACK_NAMES = ["benign_traffic", "combo", "junk", "mirai-ack", "mirai-scan", "mirai-syn", "mirai-udp",
                "mirai-udpplain", "scan", "tcp", "udp"]
DEVICE_NAMES = ["Danmini_Doorbell", "Ecobee_Thermostat", "Ennio_Doorbell", "Philips_B120N10_Baby_Monitor",
                "Provision_PT_737E_Security_Camera", "Provision_PT_838_Security_Camera",
                "Samsung_SNH_1011_N_Webcam", "SimpleHome_XCS7_1002_WHT_Security_Camera",
                "SimpleHome_XCS7_1003_WHT_Security_Camera"]
N_FEATURES = 115
TRAIN_FRACTION = 0.85
MIRAI_DIR = "mirai_attacks"
MIRAI_PREFIX = "mirai-"


def class_code(name, names: list[str]) -> Column:
    """Position of ``name`` in ``names`` (0-based), -1 when absent."""
    c = F.col(name) if isinstance(name, str) else name
    return (F.array_position(F.array(*[F.lit(n) for n in names]), c) - 1).cast("int")


def read_labelled_tree(spark: SparkSession, root: str, n_features: int | None = N_FEATURES,
                       attack_names: list[str] | None = None, device_names: list[str] | None = None) -> DataFrame:
    """S4 + U1 + D5 + P7 + P8: all ``<root>/<device>/**/*.csv`` files in one scan.

    Returns features array<float>, attack, attack_code, device, device_code,
    n_values (fields of the row) and ``width_ok``.  Every line is split on its
    own, so files may differ in width and no value is dropped: a row with
    other than ``n_features`` values, or a value that is no number (null in
    ``features``), has ``width_ok`` false.  Headers, lines without any number, are left out.
    """
    attack_names = attack_names or ATTACK_NAMES
    device_names = device_names or DEVICE_NAMES
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(root)
    fields = F.split(F.regexp_replace("value", r"[\r\"]", ""), ",", -1)
    path = F.col("_metadata.file_path")
    rel = F.regexp_extract(path, r"([^/]+/(?:[^/]+/)?[^/]+\.csv)$", 1)
    device = F.regexp_extract(path, r"([^/]+)/(?:" + MIRAI_DIR + r"/|gafgyt_attacks/)?[^/]+\.csv$", 1)
    is_mirai = path.contains(f"/{MIRAI_DIR}/")
    attack = F.when(is_mirai, label_from_file(path, MIRAI_PREFIX)).otherwise(label_from_file(path))
    feats = F.transform(fields, lambda x: F.trim(x).try_cast("float"))
    out = df.select(feats.alias("features"), attack.alias("attack"), device.alias("device"), rel.alias("source"))
    out = out.where(F.exists("features", lambda x: x.isNotNull()))
    return _judged(out, n_features, attack_names, device_names)


def _judged(df: DataFrame, n_features: int | None, attack_names: list[str], device_names: list[str]) -> DataFrame:
    """Codes, field count and ``width_ok`` for rows of (features, attack, device, …)."""
    out = df.withColumn("attack_code", class_code("attack", attack_names)) \
        .withColumn("device_code", class_code("device", device_names)) \
        .withColumn("n_values", F.size("features"))
    width_ok = F.lit(True) if n_features is None else (F.col("n_values") == n_features)
    return out.withColumn("width_ok", width_ok & ~F.exists("features", lambda x: x.isNull()))


def write_labelled_partitions(rows: DataFrame, root: str, line: str = "line") -> None:
    """Lines under ``device=…/attack=…``: the labels are in the paths alone, whatever characters they hold."""
    rows.select(F.col(line).alias("value"), "device", "attack").write.partitionBy("device", "attack").text(root)


def read_labelled_partitions(spark: SparkSession, root: str, n_features: int | None = N_FEATURES,
                             attack_names: list[str] | None = None, device_names: list[str] | None = None) -> DataFrame:
    """S4 + D5 + P7 + P8 over a tree that :func:`write_labelled_partitions` wrote, one scan for all labels.

    A filter on device or attack prunes directories.  Columns and the treatment of each line are those of
    :func:`read_labelled_tree`: mixed widths are kept, and a row that is too short, too long or holds a value that is no
    number has ``width_ok`` false.
    """
    df = spark.read.schema("value string, device string, attack string").text(root)
    fields = F.split(F.regexp_replace("value", r"[\r\"]", ""), ",", -1)
    feats = F.transform(fields, lambda x: F.trim(x).try_cast("float"))
    out = df.select(feats.alias("features"), "attack", "device", F.col("_metadata.file_path").alias("source"))
    return _judged(out.where(F.exists("features", lambda x: x.isNotNull())), n_features,
                   attack_names or ATTACK_NAMES, device_names or DEVICE_NAMES)


def content_key(*cols) -> Column:
    """Hash input for the split: the row's own values joined."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) if isinstance(c, str) else c
                              for c in cols])


def split_flag(*cols, fraction: float = TRAIN_FRACTION, seed: str = "split") -> Column:
    """T5: true for the train side: md5-uniform(seed, content) < fraction."""
    return md5_uniform(F.lit(seed), content_key(*cols)) < F.lit(fraction)


def train_test(df: DataFrame, *cols, fraction: float = TRAIN_FRACTION, seed: str = "split"):
    """T5 + U4: (train, test); test is the complement, so sides are disjoint and complete."""
    flag = split_flag(*cols, fraction=fraction, seed=seed)
    tagged = df.withColumn("_train", flag)
    return (tagged.where(F.col("_train")).drop("_train"), tagged.where(~F.col("_train")).drop("_train"))


def features_key(features: str = "features") -> Column:
    return F.concat_ws(",", F.transform(F.col(features), lambda x: x.cast("string")))
