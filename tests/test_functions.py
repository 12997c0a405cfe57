"""Column functions against plain Python, closed forms and edge cases."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import hashing, numeric, text, values


def one(spark, column, **cells):
    rows = spark.range(1).withColumns({k: F.lit(v) for k, v in cells.items()}) if cells else spark.range(1)
    return rows.select(column.alias("x")).first().x


@pytest.mark.parametrize(("path", "want"), [("a/b/c", ("c", "a/b")), ("c", ("c", ".")), ("a/", ("", "a"))])
def test_base_and_dir(spark, path, want):
    assert (one(spark, text.base_name(F.lit(path))), one(spark, text.dir_name(F.lit(path)))) == want


@pytest.mark.parametrize(("path", "want"), [("a/./b/../c", "a/c"), ("../../a", "a"), (".", "."), ("", "."), ("a//b/", "a/b")])
def test_normalise_path(spark, path, want):
    assert one(spark, text.normalise_path(F.lit(path))) == want


@pytest.mark.parametrize(("path", "want"), [("x.TS", "typescript"), ("x.d.ts", None), (".bashrc", None), ("a/b.py", "python"), ("Makefile", None)])
def test_language(spark, path, want):
    assert one(spark, text.language_of(F.lit(path))) == want
    assert one(spark, text.language_of(F.lit("run"), F.lit("#!/usr/bin/env python3"))) == "python"


@pytest.mark.parametrize(("image", "want"), [("docker.io/library/postgres:16", "postgres"), ("localhost:5000/redis@sha256:1", "redis"), ("acme/api", None), ("public.ecr.aws/docker/library/redis", "redis")])
def test_images(spark, image, want):
    assert one(spark, text.image_capability(F.lit(image))) == want


@pytest.mark.parametrize(("line", "want"), [("a-b>=1 # x", "a-b"), ("-r x", None), ("https://x/y", None), ("", None), ("# c", None)])
def test_requirement(spark, line, want):
    assert one(spark, text.requirement_name(F.lit(line))) == want


@pytest.mark.parametrize(("glob", "path", "want"), [("*.py", "a/b.py", True), ("src/*.py", "src/a/b.py", False), ("src/**/x.py", "src/a/b/x.py", True), ("?.md", "ab.md", False)])
def test_glob(spark, glob, path, want):
    assert one(spark, text.glob_match(F.lit(path), glob)) is want


def test_text_pieces(spark):
    assert one(spark, text.term_in_span(F.lit("It’s  A"), F.lit("so it's\na test")))
    assert one(spark, text.line_of_byte(F.lit("é\nb\nc"), F.lit(3))) == 2
    assert one(spark, text.line_slice(F.lit("a\nb\nc"), F.lit(2), F.lit(9))) == "b\nc"
    assert one(spark, text.line_slice(F.lit("a"), F.lit(2), F.lit(3))) is None
    assert one(spark, text.identifier(F.lit("2fastCar"))) == "r_2fast_car"
    assert [tuple(s) for s in one(spark, text.segments(F.lit("a[1][sku:x]``` `b` ```py\nc\n```[`")))] == [("text", None, "a[1]"), ("citation", "sku", "x"), ("text", None, "``` "), ("code", None, "b"), ("text", None, " "), ("block", "py", "c"), ("text", None, "[`")]
    # the reference cuts the name to 32 before the suffix, and says app where nothing is left of it
    assert one(spark, text.resource_name(F.lit("--"), F.lit("db"))) == "app-db"
    assert one(spark, text.resource_name(F.lit("x" * 40), F.lit("svc"))) == "x" * 32 + "-svc"
    assert one(spark, text.resource_name(F.lit("A_b  C-"), F.lit("svc"))) == "a-b-c-svc"


def test_hashes(spark):
    assert one(spark, hashing.content_hash(F.lit("x"))) == hashlib.sha256(b"x").hexdigest()
    assert one(spark, hashing.skipped_hash(F.lit("Binary"))) == hashlib.sha256(b"skip\0Binary").hexdigest()
    assert one(spark, hashing.json_digest(F.lit('{"b":1,"a":2}'))) == hashlib.sha256(b'{"a":2,"b":1}').hexdigest()
    assert one(spark, hashing.json_digest(F.lit("no"))) is None


@pytest.mark.parametrize(("x", "want"), [(-2.5, -2.0), (2.5, 3.0), (0.0, 0.0)])
def test_half_up(spark, x, want):
    assert one(spark, numeric.half_up(F.lit(x))) == want


def test_queue_closed_form(spark):
    q = numeric.queue(F.lit(10.0), F.lit(50.0), F.lit(1))
    assert math.isclose(one(spark, q["total_ms"]), 1000 / (100 - 50))
    assert math.isclose(one(spark, numeric.percentile_ms(q, 0.95)), math.log(20) * 20, rel_tol=1e-9)
    full = numeric.queue(F.lit(10.0), F.lit(5000.0), F.lit(1))
    assert one(spark, full["saturated"]) and math.isclose(one(spark, full["total_ms"]), 10 / (1 - 0.95))
    assert one(spark, numeric.queue(F.lit(0.0), F.lit(5.0), F.lit(1))["model"]) == "fixed"
    assert 0 < one(spark, numeric.erlang_c(F.lit(500), F.lit(0.9))) < 1


def test_breaking_rate(spark):
    use = lambda r: r * 0.01
    assert abs(one(spark, numeric.breaking_rate(use, F.lit(10.0))) - 1000) <= 0.5
    assert one(spark, numeric.breaking_rate(use, F.lit(1e9))) is None
    assert one(spark, numeric.breaking_rate(use, F.lit(0.0))) == 0


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, numeric.norm(a)) == 5 and one(spark, numeric.cosine_distance(a, zero)) is None
    assert one(spark, numeric.unit(zero)) == [0.0, 0.0]


@pytest.mark.parametrize(("t", "want"), [("80:90", 80), ("0", None), ("70000", None), ("8000-8100/udp", 8000), ("x", None)])
def test_ports(spark, t, want):
    assert one(spark, values.port(F.lit(t))) == want


def test_values(spark):
    assert one(spark, values.container_port(F.lit("127.0.0.1:80:8080/tcp"))) == 8080
    assert one(spark, values.pointer("a/b", "c~d")) == "/a~1b/c~0d"
    assert one(spark, values.lenient_flag(F.lit(" Yes "))) is True
    assert one(spark, values.unit_name(F.lit("furlong"))) is None
