import os
import tempfile

from pyspark.sql import functions as F

from nnspark.operators import dataset


def _tree():
    root = tempfile.mkdtemp(prefix="nn-tree-")
    devices = ["Danmini_Doorbell", "Ennio_Doorbell", "Ecobee_Thermostat"]
    n = 0
    for d in devices:
        files = {"benign_traffic.csv": None, "gafgyt_attacks/scan.csv": None, "gafgyt_attacks/udp.csv": None}
        if d != "Ennio_Doorbell":
            files.update({"mirai_attacks/ack.csv": None, "mirai_attacks/udp.csv": None})
        for rel in files:
            p = os.path.join(root, d, rel)
            os.makedirs(os.path.dirname(p), exist_ok=True)
            with open(p, "w") as f:
                f.write("a,b,c,d\n")
                for i in range(20):
                    f.write(f"{n},{i},{len(d)},{len(rel)}\n")
                    n += 1
    return root, n


def test_labels_codes_and_split(spark):
    root, n = _tree()
    df = dataset.read_labelled_tree(spark, root, n_features=4).cache()
    assert df.count() == n
    labels = {(r["device"], r["attack"]) for r in df.select("device", "attack").distinct().collect()}
    assert ("Ennio_Doorbell", "mirai-ack") not in labels
    assert ("Danmini_Doorbell", "mirai-ack") in labels and ("Ecobee_Thermostat", "scan") in labels
    codes = {r["attack"]: r["attack_code"] for r in df.select("attack", "attack_code").distinct().collect()}
    assert codes == {"benign_traffic": 0, "scan": 8, "udp": 10, "mirai-ack": 3, "mirai-udp": 6}
    assert df.where(~F.col("width_ok")).count() == 0
    assert df.where("device_code < 0").count() == 0
    # label stays with its row: the first feature encodes the row, and the label is a column of that row
    cols = ["device", "attack", dataset.features_key()]
    train, test = dataset.train_test(df, *cols)
    tr, te = train.count(), test.count()
    assert tr + te == n and train.join(test, ["features", "device", "attack"]).count() == 0
    assert 0.6 < tr / n < 0.98
    train2, _ = dataset.train_test(df.repartition(7), *cols)
    assert sorted(r["features"][0] for r in train.collect()) == sorted(r["features"][0] for r in train2.collect())


def test_rows_are_checked_one_by_one(spark, tmp_path):
    """Files of different widths in one tree: every value is kept, and wrong rows are marked."""
    files = {"a.csv": "x,y,z\n1,2,3\n4,5\n", "b.csv": "w,x,y,z\n1,2,3,4\n5,6,seven,8\n", "c.csv": "x,y,z\n7,8,9\n"}
    for name, text in files.items():
        (tmp_path / "Danmini_Doorbell").mkdir(exist_ok=True)
        (tmp_path / "Danmini_Doorbell" / name).write_text(text)
    got = {tuple(r["features"]): (r["n_values"], r["width_ok"])
           for r in dataset.read_labelled_tree(spark, str(tmp_path), n_features=3).collect()}
    assert got == {(1, 2, 3): (3, True), (4, 5): (2, False), (1, 2, 3, 4): (4, False), (5, 6, None, 8): (4, False), (7, 8, 9): (3, True)}


def test_labelled_partitions_keep_labels_widths_and_rejects(spark):
    root = os.path.join(tempfile.mkdtemp(prefix="nn-parts-"), "t")
    rows = [("1,2,3", "Danmini_Doorbell", "scan"), ("4,5", "Danmini_Doorbell", "scan"), ("6,x,7", "odd / name=1%", "mirai-udp"),
            ("a,b,c", "Ennio_Doorbell", "udp"), ("8,9,10,11", "Ennio_Doorbell", "12"), ('"13", 14 ,15', None, "tcp")]
    dataset.write_labelled_partitions(spark.createDataFrame(rows, "line string, device string, attack string"), root)
    got = dataset.read_labelled_partitions(spark, root, n_features=3)
    found = sorted(((r["features"][0], r["device"], r["device_code"], r["attack"], r["attack_code"], r["n_values"], r["width_ok"])
                    for r in got.collect()), key=str)
    assert found == sorted([(1.0, "Danmini_Doorbell", 0, "scan", 8, 3, True), (4.0, "Danmini_Doorbell", 0, "scan", 8, 2, False),
                            (6.0, "odd / name=1%", -1, "mirai-udp", 6, 3, False), (8.0, "Ennio_Doorbell", 2, "12", -1, 4, False),
                            (13.0, None, None, "tcp", 9, 3, True)], key=str)  # a line without any number is a header
    plan = got.where("device = 'Ennio_Doorbell'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(device" in plan
