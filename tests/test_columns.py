"""Golden values of the scalar operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftlog.functions import net, text, time
from siftlog.operators import documents


def apply(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_ports(spark):
    values = [None, "", "abc", "443", "8080", "55000", "443.0", "nan", "70000", "-1", " 22 "]
    assert apply(spark, net.port_bucket, values) == ["missing", "missing", "invalid", "well_known", "registered", "ephemeral", "well_known", "invalid", "out_of_range", "out_of_range", "well_known"]
    assert apply(spark, net.port_class, [None, "x", "443.0", "443", "1024", "49152", "99999999999999999999", "0080"]) == ["none", "none", "none", "wellknown", "registered", "ephemeral", "ephemeral", "wellknown"]


def test_addresses(spark):
    values = ["", "10.0.0.1", "01.2.3.4", "256.1.1.1", "fe80::1", "::", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "1::2::3", "x"]
    assert apply(spark, net.value_kind, values) == ["missing", "ipv4", "other", "other", "ipv6", "ipv6", "ipv6", "ipv6", "other", "other"]
    assert apply(spark, net.ip_prefix, ["10.1.2.3", None, "x"]) == ["10.1.2", "missing", "non_ipv4"]
    private = ["0.1.1.1", "10.1.1.1", "127.0.0.1", "169.254.1.1", "172.16.0.1", "192.0.0.1", "192.0.2.1", "192.168.1.1", "198.18.0.1", "198.51.100.1", "203.0.113.1", "240.0.0.1", "fe80::1", "fc00::1", "::1"]
    assert set(apply(spark, net.ip_kind, private)) == {"private"}
    assert apply(spark, net.ip_kind, ["100.64.0.1", "100.127.255.255", "100.128.0.1", "8.8.8.8", "192.0.0.9", "172.32.0.1", "2606:4700::1111", "", None, "host"]) == ["cgnat", "cgnat", "public", "public", "public", "public", "public", "none", "none", "other"]


CONTENT = {
    "<134>1 USER-9546-07-26T06:28:52.711895-05:00 ORG-3043 started": "<134>1 tok_userTtok_time tok_org started",
    "Jan  6 12:25:01 sshd[43386]: disconnect from 10.182.42.183 Monitor": "tok_date tok_time sshd[tok_num]: disconnect from tok_ip Monitor",
    "eni-083fb4fb2d7048814 1722336259 2024-07-26 Sunday": "eni-tok_hex tok_epoch tok_date tok_weekday",
    None: "",
}
TIMEFREE = {
    "<14>May  8 00:04:50 USER-0010-0051 1,USER-9564/05/08 00:04:49,TRAFFIC,drop,udp": "<0>tok_cal  0 0:0:0 0 0,0/0/0 0:0:0,TRAFFIC,drop,udp",
    "2 100000000001 eni-0ec1cf3543aa16eec 10.100.6.190 167CRED-25166941 REJECT OK": "0 0 eni-tok_hex 0.0.0.0 0 REJECT OK",
    "2 100000013063 ORG-1504 100.64.0.230 17CRED-CRED-28950023 REJECT OK": "0 0 0 0.0.0.0 0 REJECT OK",
    "Sunday 11:28 PM EDT": "tok_cal 0:0 tok_cal tok_cal",
}
VERDICT = {
    "TRAFFIC,drop,udp": "block",
    "decision=blocked accepted": "block",
    "flow ACCEPT OK": "allow",
    "AccessDenied by policy": "none",
    '{"X-Xss-Protection":["1; mode=block"],"status":"allowed"}': "none",
    '{\\"X-Frame-Options\\":\\"DENY\\"}': "none",
    "CEF:0|WAF|act=DENY msg=x": "block",
    "fqdn=HOST-500127 ::: HOST-0121=BLOCKED": "block",
    None: "none",
}


@pytest.mark.parametrize(("f", "cases"), [(text.normalized, CONTENT), (text.timefree, TIMEFREE), (text.firewall_verdict, VERDICT)])
def test_message_views(spark, f, cases):
    assert apply(spark, f, list(cases)) == list(cases.values())


def test_classifier_view(spark):
    a, b = apply(spark, text.classifier_view, ["<180>Jul 26 USER-9564 22:45:31: Deny tcp HOST-12 to 10.0.0.1/445", "<181>Aug 01 USER-1 01:00:00: Deny tcp HOST-99 to 10.2.0.9/80"])
    assert a == b and "zuser" in a and "9564" not in a
    got = apply(spark, text.classifier_view, ["S Jul20 0:00 [kdmflush]", "Market", "CRED-USER-12 x", "Monday May", None])
    assert "zmon" in got[0] and got[1] == "Market" and got[2] == "zcred x" and got[3] == "zday zmon" and got[4] == ""


def test_reader_view(spark):
    got = apply(spark, text.reader_view, ['Jul 26 06:10:17 host "code":"4625" dst 10.0.0.1/445 at 1721992874', None])
    assert "4625" in got[0] and "10.0.0.1/445" in got[0] and "06:10:17" not in got[0] and "1721992874" not in got[0] and got[1] == ""


def test_views_do_not_change_with_numbers_and_dates(spark):
    messages = [m for m in (*CONTENT, *TIMEFREE, *VERDICT) if m]
    rows = spark.createDataFrame([(m,) for m in messages], "m string")
    for view in (text.timefree, text.firewall_verdict):
        same = rows.select(view(text.timefree(F.col("m"))).alias("a"), view(text.timefree(text.timefree(F.col("m")))).alias("b"))
        assert same.where("a <> b").count() == 0


def test_time_parts(spark):
    got = apply(spark, lambda v: F.array(*time.time_parts(v).values()), ["1722429000.0", None, "x", "nan"])
    assert got == [[12, 2, 7], [-1, -1, -1], [-1, -1, -1], [-1, -1, -1]]


def test_tokens(spark):
    assert apply(spark, text.clean_token, [None, "  ", "a b", "é(x)", "___", "A=b@c"]) == ["missing", "missing", "a_b", "x", "missing", "A=b@c"]
    assert apply(spark, text.slug, [None, "Amazon Web Services", "--"]) == ["none", "amazon_web_services", "none"]


def test_documents_tolerate_missing_columns(spark):
    df = spark.createDataFrame([("e1", "Deny tcp x")], "event_id string, message_sanitized string")
    doc = df.select(documents.timefree_document(df).alias("d")).first()["d"]
    assert "fw_action=block" in doc and "fw_action_vendor=block_missing" in doc and "src_port_bucket=missing" in doc
    assert df.select(documents.verdict_cell(df)[0]).first()[0] == "missing"
    same = documents.per_distinct(df.union(df), "message_sanitized", text.firewall_verdict, "v").collect()
    assert [r["v"] for r in same] == ["block", "block"]


def test_counterfactual_messages_keep_their_shape(spark):
    values = [None, "", "Jul 26 Jul 27 Jul 28 Fri 2024-07-26 Mayor", "no time at all", "Mon Tue Mon Tue Mon Tue Mon Tue", "Jan Jan Jan Jan Jan Jan Jan Jan"]
    got = apply(spark, lambda c: text.perturbed(c, 3), values)
    again = apply(spark, lambda c: text.perturbed(c, 3), values[::-1])[::-1]
    other = apply(spark, lambda c: text.perturbed(c, 4), values)
    assert got == again and got[2] != other[2]
    assert got[0] == got[1] == "" and got[3] == values[3]
    months = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
    days = "Mon Tue Wed Thu Fri Sat Sun".split()
    w = got[2].split()
    assert {w[0], w[2], w[4]} <= set(months) and w[6] in days and w[8] == "Mayor" and len(w[7]) == 10 and w[7][4] == w[7][7] == "-"
    # Each occurrence is drawn for itself.
    assert len(set(got[4].split())) > 2 and set(got[4].split()) <= set(days)
    assert len(set(got[5].split())) > 2 and set(got[5].split()) <= set(months)
