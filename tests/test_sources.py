import os
import tempfile

from nnspark.sources import keywords, results


def test_ranked_csv_round_trip(spark):
    rows = [("q1", 1, "t1", 11, 0.5, 3.25, 0.1), ("q1", 2, "t2", 12, 0.75, 3.25, 0.1), ("q2", 1, "t3", 13, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "query string, rank int, text string, id long, dist double, time_ms double, "
                                     "spread double")
    d = tempfile.mkdtemp(prefix="nn-csv-")
    results.write_ranked_csv(df, os.path.join(d, "r"))
    back = results.read_ranked_csv(spark, os.path.join(d, "r"))
    m = {r["query"]: r for r in results.result_metrics(back).collect()}
    assert abs(m["q1"]["sum_dist"] - 1.25) < 1e-12 and m["q1"]["cost"] == 3.25 and m["q2"]["n_hits"] == 1


def test_old_csv_without_time_and_blank_lines(spark):
    d = tempfile.mkdtemp(prefix="nn-csv-")
    p = os.path.join(d, "old.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("Query,Rank,Matched Keyword,Matched ID,Distance\nq,1,a,5,4.0\n\nq,2,b,6,9.0\n\n")
    back = results.read_ranked_csv(spark, p, squared=True)
    m = results.result_metrics(back).first()
    assert m["sum_dist"] == 5.0 and m["cost"] == 0.0 and m["n_hits"] == 2


def test_damaged_rows_are_rejected_and_counted(spark):
    d = tempfile.mkdtemp(prefix="nn-csv-")
    p = os.path.join(d, "r.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("Query,Rank,Matched Keyword,Matched ID,Distance,Search Time (ms),Internal Similarity\n"
                "q,1,a,5,4.0,1.5,0.2\nq,2,b,x,9.0,1.5,0.2\nq,,c,7,1.0\nq,4,d,8,far\n\nq,5,e,9\nq,6,f,,2.0,slow\n"
                "q,7,g,11,NaN\nq,8,h,12,inf\nq,9,\"i, j\",13, 2.5 ,,much\nq,10,k,,3.0\nr,1,l,1,-0.5\n")
    good, bad = results.read_ranked_csv_checked(spark, p)
    assert [(r["rank"], r["id"], r["dist"], r["time_ms"]) for r in good.orderBy("query", "rank").collect()] == [
        (1, 5, 4.0, 1.5), (10, None, 3.0, 0.0), (1, 1, -0.5, 0.0)]
    got = sorted((r["rank"] or "", r["reason"]) for r in bad.collect())
    assert got == [("", "rank"), ("2", "id"), ("4", "dist"), ("5", "dist"), ("6", "time_ms"), ("7", "dist"), ("8", "dist"), ("9", "spread")]
    assert bad.where("file like '%r.csv'").count() == 8
    m = results.result_metrics(results.read_ranked_csv(spark, p, squared=True)).orderBy("query").collect()
    assert m[0]["n_hits"] == 2 and m[1]["sum_dist"] == 0.0


def test_vectors_round_trip(spark, emb):
    d = tempfile.mkdtemp(prefix="nn-vec-")
    results.write_vectors(emb, os.path.join(d, "v"))
    back = results.read_vectors(spark, os.path.join(d, "v"))
    assert back.exceptAll(emb).count() == 0 and back.count() == emb.count()


def test_lines_are_numbered_across_splits_and_files(spark):
    d = tempfile.mkdtemp(prefix="nn-lines-")
    want = []
    for name, n in (("a.txt", 3000), ("b.txt", 1), ("c.txt", 40)):
        lines = [f"{name} line {i}" if i % 7 else "" for i in range(n)]
        want += lines
        with open(os.path.join(d, name), "w", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r["line_no"]: r["line"] for r in keywords.read_lines(spark, d).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [got[i] for i in range(len(got))] == want


def test_entity_list_keeps_blank_names_and_quoted_breaks(spark):
    d = tempfile.mkdtemp(prefix="nn-entities-")
    with open(os.path.join(d, "list.csv"), "w", encoding="utf-8") as f:
        f.write('name,kind\n  b ,1\n\n,2\n"a\nc ""x""",3\nb,4\n')
    got = [(r["entity"], r["ord"], r["n"]) for r in keywords.read_entity_list(spark, d).orderBy("ord").collect()]
    assert got == [("b", 0, 2), ("", 1, 1), ('a\nc "x"', 2, 1)]
