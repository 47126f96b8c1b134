"""Lists of locations as tables against a comparison of every path with every place."""

import random

import pytest

from evidlake.operators import encrypted, hashes
from evidlake.operators.locations import in_listed_places, outside_listed_places, place_hits

FILES = "path string, n long, place string, low string, key string"


def brute(paths, places, at_start):
    places = {p.lower() for p in places if p}
    return sorted(
        (path, p) for path in {x for x in paths if x is not None} for p in places
        if (path.lower().startswith(p) if at_start else p in path.lower())
    )


def table(spark, paths):
    return spark.createDataFrame([(p, i, "x", "y", "z") for i, p in enumerate(paths)], FILES)


def listed(spark, places):
    return spark.createDataFrame([(p,) for p in places], "place string")


@pytest.fixture(params=["10MB", "-1"])
def any_join(spark, request):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("at_start", [False, True])
def test_against_all_comparisons(spark, rows, any_join, at_start):
    rng = random.Random(5)
    part = lambda: "".join(rng.choice("abAé/") for _ in range(rng.randint(0, 7)))
    paths = ["/" + part() + "/" + part() + "/Temp/" + part() for _ in range(300)] + ["", None, "/", "/Temp"] * 2
    paths += ["/deep" * 40 + f"/{i}" for i in range(20)]
    places = [part() for _ in range(200)] + ["/TEMP/", "/deep" * 40, "/deep" * 40 + "/1", None, "", "/Temp", "/temp"]
    got = rows(place_hits(table(spark, paths), listed(spark, places), at_start), "path", "place")
    want = brute(paths, places, at_start)
    assert got == want and len(want) > 100
    best = {}
    for path, place in want:
        best[path] = min(best.get(path, (0, "")), (-len(place), place))
    inside = in_listed_places(table(spark, paths), listed(spark, places), at_start)
    assert sorted(inside.columns) == ["key", "low", "n", "path", "place"]
    assert rows(inside, "n", "place") == sorted((i, best[p][1]) for i, p in enumerate(paths) if p in best)
    out = outside_listed_places(table(spark, paths), listed(spark, places), at_start)
    assert rows(out, "n") == [(i,) for i, p in enumerate(paths) if p not in best]


def test_no_rows(spark):
    files, none = table(spark, ["/a", None]), listed(spark, [None, ""])
    assert place_hits(files, none).count() == 0
    assert in_listed_places(files, none.limit(0)).count() == 0
    assert outside_listed_places(files, none).count() == 2
    assert outside_listed_places(files.limit(0), listed(spark, ["/a"])).count() == 0


def test_a_common_beginning_is_not_a_common_key(spark):
    places = listed(spark, [f"/home/user{i:05d}/" for i in range(3000)])
    hits = place_hits(table(spark, [f"/home/user{i:05d}/x" for i in range(0, 3000, 7)]), places)
    assert hits.count() == 429


def test_operators_take_a_table(spark, rows):
    found = hashes.suspicious_files(
        spark.createDataFrame([("/Srv/In/a.exe", "s"), ("/srv/in/a.txt", "s"), ("/tmp/b.exe", None)], "path string, sha256 string"),
        listed(spark, ["/srv/in"]),
    )
    assert rows(found, "path", "extension", "sha256") == [("/Srv/In/a.exe", ".exe", "s")]
    files = spark.createDataFrame(
        [("/Data/a.gpg", 5, b"abcde"), ("/data2/b.gpg", 5, b"abcde"), ("/proc/c.gpg", 5, b"abcde")],
        "path string, size long, content binary",
    )
    scanned = encrypted.scan_encrypted(files, excluded=listed(spark, ["/DATA/"]))
    assert rows(scanned, "path") == [("/data2/b.gpg",)]
