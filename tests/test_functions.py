import json

import pytest
from pyspark.sql import functions as F

from footfall.functions import actors, json as J, text, web


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).head()[0]


def model_metric_type(raw):
    """Character by character, as the clean-up is defined."""
    out, before = "", ""
    for c in raw.strip("".join(map(chr, range(33)))):
        if c in "-_ ":
            if before and before != "_":
                out, before = out + "_", "_"
            continue
        if c.isupper() and before.islower():
            out += "_"
        out += c.lower()
        before = c.lower()
    out = out.strip("_")
    return "page_view" if out == "pageview" else out


@pytest.mark.parametrize(
    "raw",
    ["PageView", "pageview", "PAGEVIEW", "page-view", " page  view ", "page_-_View", "URL", "aB1C", "1AB", "--", "_x_", "été-Être", "\tClick\n", "a-B", "JSError URL", "x\ty"],
)
def test_metric_type(spark, raw):
    assert one(spark, text.metric_type, raw) == model_metric_type(raw)
    assert one(spark, text.no_metric_type, raw) == (model_metric_type(raw) == "")


def test_metric_type_length(spark):
    assert one(spark, lambda v: text.metric_type_too_long(v, 50), "aB" * 17) is True  # 34 letters and 17 underscores
    assert one(spark, lambda v: text.metric_type_too_long(v, 50), "a" * 50) is False


@pytest.mark.parametrize(
    "ip,want",
    [
        ("203.0.113.42", "203.0.113.***"), ("2001:db8:85a3::8a2e:370:7334", "2001:db8:***"), ("::1", "***"), ("", "-"),
        (None, "-"), ("not-an-ip", "***"), ("1.2.3", "***"), ("1.2.3.4.", "1.2.3.***"),
    ],
)
def test_mask_ip(spark, ip, want):
    assert one(spark, web.mask_ip, ip) == want


@pytest.mark.parametrize(
    "agent,want", [("Googlebot/2.1", True), ("YANDEXBOT", True), ("Baiduspider", True), ("ia_archiver", True), ("Mozilla/5.0", False), (None, False), ("", False)]
)
def test_bot(spark, agent, want):
    assert one(spark, web.is_bot, agent) is want


@pytest.mark.parametrize(
    "forwarded,want", [(None, "peer"), (" ", "peer"), (" 1.1.1.1 , 2.2.2.2", "1.1.1.1"), ("3.3.3.3", "3.3.3.3"), (",4.4.4.4", ",4.4.4.4")]
)
def test_client_ip(spark, forwarded, want):
    assert one(spark, lambda v: web.client_ip(v, F.lit("peer")), forwarded) == want


def test_visitor(spark):
    device = "3F2504E0-4F89-11D3-9A0C-0305E82C3301"
    assert one(spark, lambda v: web.visitor_id(v, F.lit("b1")), device) == device.lower()
    made = one(spark, lambda v: web.visitor_id(v, F.lit("b1"), F.lit(None)), "junk")
    assert one(spark, text.is_uuid, made) and made == one(spark, lambda v: web.visitor_id(v, F.lit("b1"), F.lit(None)), None)
    assert len(one(spark, actors.user_of_device, device)) == 32


@pytest.mark.parametrize("value,want", [(None, True), ("", True), (" \t ", True), (" ", False), (" a", False)])
def test_blank(spark, value, want):
    assert one(spark, text.is_blank, value) is want


def test_source_and_project(spark):
    assert one(spark, text.privacy_source, None) == "APP_SETTINGS"
    assert one(spark, text.privacy_source, " web-form ") == "WEB-FORM"
    assert one(spark, text.privacy_source, "bad source") is None
    assert one(spark, text.project_id, " de​mo  ") == "demo"


@pytest.mark.parametrize(
    "document,want",
    [
        ('{"a":1}', {"a": 1, "x": "q\"t"}),
        ("{ }", {"x": "q\"t"}),
        ('{"x":"old","n":{"x":[1,null]}}', {"n": {"x": [1, None]}, "x": "q\"t"}),
        ('{"\\u0078":"old"}', {"x": "q\"t"}),
        (None, {"x": "q\"t"}),
        ("null", {"x": "q\"t"}),
        ("[1,2]", {"data": [1, 2], "x": "q\"t"}),
        ('"text"', {"data": "text", "x": "q\"t"}),
    ],
)
def test_members(spark, document, want):
    got = one(spark, lambda v: J.with_members(J.wrapped(v), {"x": F.lit('q"t'), "skipped": F.lit(None).cast("string")}), document)
    assert json.loads(got) == want


def test_content_id_is_stable(spark):
    df = spark.sql("select timestamp'2024-01-01 00:00:00.1239' at, 'a' a, cast(null as string) b")
    ids = {df.select(actors.content_id("evt", F.col("at"), F.col("a"), F.col("b"))).head()[0] for _ in range(2)}
    assert len(ids) == 1 and ids.pop().startswith("evt_1704067200123_")
