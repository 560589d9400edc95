import os
import tempfile

from pyspark.sql import functions as F

from nnspark.operators import querygen
from nnspark.sources import keywords

# Entity names of the published 52-query set (reconstructed).
G4_ENTITIES = (
    [f"{y}_FIFA_World_Cup_squads" for y in (1982, 1986, 1990, 1994, 1998, 2002, 2006, 2010)]
    + [f"{y}_FIFA_U-20_World_Cup_squads" for y in (2007, 2009)]
    + [f"{y}_FIFA_World_Youth_Championship_squads" for y in (1999, 2003, 2005)]
    + ["2013–14_Illinois_Fighting_Illini_men's_basketball_team",
       "2014_NCAA_Men's_Division_I_Basketball_Tournament",
       "List_of_Harvard_University_people"]
    + [f"List_of_{f}_chapters" for f in ("Delta_Sigma_Theta", "Kappa_Alpha_Psi", "Lambda_Chi_Alpha", "Phi_Beta_Sigma")]
)


def _lines(spark, lines):
    return spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "line_no long, line string")


def test_parse_edge_cases(spark):
    lines = ["12 hello world", "9", "", "x y", "  5   a  b  ", "7\tfoo　"]
    parsed, rejects = keywords.parse_lines(_lines(spark, lines))
    got = {r["line_no"]: (r["id"], r["text"]) for r in parsed.collect()}
    assert got == {0: (12, "hello world"), 4: (5, "a  b"), 5: (7, "foo")}
    assert [r["line_no"] for r in rejects.collect()] == [3]


def test_keep_last_from_file(spark):
    d = tempfile.mkdtemp(prefix="nn-kw-")
    p = os.path.join(d, "keyword.txt")
    with open(p, "w", encoding="utf-8") as f:
        f.write("1 first\n2 two\n1 second\n\nbad line\n")
    m = {r["id"]: r["text"] for r in keywords.read_keyword_corpus(spark, p).collect()}
    assert m == {1: "second", 2: "two"}


def test_entity_list_csv(spark):
    d = tempfile.mkdtemp(prefix="nn-ent-")
    p = os.path.join(d, "entities.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("name,count\n  B_x ,1\n\nA_y,2\nB_x,3\n\n")
    got = [r["entity"] for r in keywords.read_entity_list(spark, p).orderBy("ord").collect()]
    assert got == ["B_x", "A_y"]


def test_g4_expansion_gives_52_queries(spark):
    ents = spark.createDataFrame([(i, e) for i, e in enumerate(G4_ENTITIES)], "ord long, entity string")
    out = querygen.expand(ents).orderBy("ord").collect()
    qs = [r["query"] for r in out]
    assert len(qs) == 52 == len(set(qs))
    for q in ("2007 FIFA U-20 World Cup squads", "2010 football tournament players", "Harvard University people",
              "FIFA football cup squads from 1982", "Harvard alumni in Massachusetts",
              "Delta Sigma Theta college fraternity chapters", "American college fraternity Phi Beta Sigma",
              "NCAA basketball tournament brackets", "Illinois college basketball team players",
              "1999 FIFA World Youth Championship squads"):
        assert q in qs
    # order: entity order, then template order
    assert qs[:3] == ["1982 FIFA World Cup squads", "1982 football tournament players",
                      "FIFA football cup squads from 1982"]
    # the lower-case "basketball" entity skips the Basketball branch and takes Fighting_Illini
    assert "Illinois college basketball team players" in qs
