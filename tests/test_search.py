import pytest

from feedlens.operators import browse as B
from feedlens.operators import filters as FL
from feedlens.operators import search as S
from feedlens.plans import intent as I

M = [
    ("c1", 0, "语音输入 用不了", "iOS", "iPhone15,2"), ("c1", 1, "谢谢", "iOS", "iPhone15,2"), ("c2", 0, "键盘", "Win", "ThinkPad X1"), ("c2", 1, "卡顿", "Win", "ThinkPad X1"), ("c3", 0, "键盘卡顿 CRASH_a%b", "Mac", None),
    ("c4", 0, "x" * 2000 + "crash", "Android", "Pixel 8"), ("c5", 0, None, "Android", "Pixel 8"), ("c6", 1, "垃圾 语音 不准", "iOS", ""),
]
C = [(f"c{i}", "A.Bug" if i % 2 else "C.咨询", "性能|账号" if i % 2 else "", "P0" if i == 1 else "P3", 0.9, "r", 1, 1000 * i, 1000 * i, f"u{i}", "3.5.0" if i < 4 else "3.50", "app", None, None) for i in range(1, 8)]


@pytest.fixture(scope="module")
def tables(spark):
    m = spark.createDataFrame([(f"m{k}", *r) for k, r in enumerate(M)], "feedback_id string, conversation_id string, msg_seq int, text string, platform string, device_name string")
    c = spark.createDataFrame(C, "conversation_id string, L1 string, L2 string, severity string, confidence double, reason string, msg_count long, first_ts_ms long, last_ts_ms long, user_vid string, appversion string, channel string, service_vid long, external_chat_url string")
    return c, m


def ids(df):
    return sorted(r.conversation_id for r in df.collect())


@pytest.mark.parametrize(
    ("groups", "excludes", "want"),
    [
        ([(["键盘", "卡顿"], "AND")], [], ["c3"]),  # in one message
        ([(["键盘", "卡顿"], "OR")], [], ["c2", "c3"]), ([(["crash"], "AND")], [], ["c3", "c4"]), ([(["CRASH"], "AND")], ["键盘"], ["c4"]), ([(["语音"], "AND"), ([], "OR"), (["a%b"], "AND")], ["谢谢"], ["c3", "c6"]), ([(["a_b"], "OR")], [], []),
    ],
)
def test_keywords(tables, groups, excludes, want):
    assert ids(S.keyword_search(*tables, [S.KeywordGroup(*g) for g in groups], excludes)) == want


def test_description():
    assert S.describe([S.KeywordGroup(["a", "b"]), S.KeywordGroup([]), S.KeywordGroup(["c", "d"], "OR")], ["x", "y"]) == "包含'a' 和 'b'，包含'c' 或 'd'，排除'x'、'y'"
    assert S.describe([]) == ""


def test_keyword_errors(tables):
    with pytest.raises(ValueError):
        S.keyword_search(*tables, [S.KeywordGroup([])], ["x"])
    with pytest.raises(ValueError):
        S.KeywordGroup(["a"], "XOR")


def test_intent(tables):
    assert ids(S.intent_search(*tables, S.Intent(must=[["语音", "x"], ["用不了", "不准"]]))) == ["c1", "c4", "c6"][0::2]
    assert ids(S.intent_search(*tables, S.Intent(should=[["键盘"], ["垃圾"]], exclude=["不准"]))) == ["c2", "c3"]
    assert ids(S.intent_search(*tables, S.Intent(exclude=["键盘"]))) == ["c1", "c4", "c5", "c6", "c7"]
    with pytest.raises(ValueError):
        S.intent_search(*tables, S.Intent(must=[[" "]]))


def test_regex(tables):
    assert ids(S.regex_search(*tables, S.PatternGroups([(["crash"], "OR")]))) == ["c3"]  # c4 is too long
    assert ids(S.regex_search(*tables, S.PatternGroups([(["键盘", "卡.?顿"], "AND"), (["^垃圾"], "AND")], "OR"))) == ["c3", "c6"]
    assert S.safe_patterns(["ok", "(", "x" * 201, "(a+)+", "a.*b.*c", ".**", 5, "a.*b"]) == ["ok", "a.*b"]
    assert S.safe_patterns(["(ab)*", "(?:ab|c)+x", "(a{2,})?", "((a.+)b){3}", ".+?x.*", "(.*a|b.*)", "(?=.*a).*"]) == []
    fine = ["a+b*c{3,}", "(ab)?c", "(a|b){2,4}", "(?:a|b)+x", "[.]*x[+]+.*", r"\(x\)", "(?i)voice.{0,9}bad", "(语音|键盘).*不好用", "^$"]
    assert S.safe_patterns(fine) == fine
    with pytest.raises(ValueError):
        S.regex_search(*tables, S.PatternGroups([(["("], "OR")]))


def test_fallback(tables):
    assert S.plain_words(["(?=语音).*crash", "a1b", "x y z"]) == ["语音", "crash", "a", "b", "x"]
    assert ids(S.fallback_search(*tables, ["垃圾!?"])) == ["c6"]


@pytest.mark.parametrize(
    ("filters", "want"),
    [
        ({"L1": "A.Bug"}, ["c1", "c3", "c5", "c7"]), ({"L2": "性能", "severity": "P0"}, ["c1"]), ({"platform": "iOS, Mac ,"}, ["c1", "c3", "c6"]), ({"appversion": "3.5"}, [f"c{i}" for i in range(1, 8)]), ({"appversion": "3.50"}, ["c4", "c5", "c6", "c7"]),
        ({"device_name": "pixel,THINK"}, ["c2", "c4", "c5"]), ({"since": "1970-01-01 00:00:02", "until": "1970-01-01T00:00:03"}, ["c2", "c3"]), ({"q": "crash", "platform": "Mac"}, ["c3"]), ({}, [f"c{i}" for i in range(1, 8)]),
    ],
)
def test_filters(tables, filters, want):
    assert ids(FL.narrow(*tables, FL.Filters(**filters))) == want


@pytest.mark.parametrize("bad", [{"L1": "x"}, {"L2": "x"}, {"severity": "P9"}, {"since": "soon"}])
def test_bad_filters(bad):
    with pytest.raises(ValueError):
        FL.Filters(**bad)


def test_page(tables):
    rows = B.page(*tables, limit=3, offset=1).orderBy("last_ts_ms").collect()
    assert [r.conversation_id for r in rows] == ["c4", "c5", "c6"]
    assert [len(r.preview_text) for r in rows] == [80, 0, 0] and rows[2].platform == "" and rows[0].service_vid == 10000 and rows[0].external_chat_url.endswith("userVid=u4")
    for bad in ({"limit": 0}, {"limit": 501}, {"offset": -1}):
        with pytest.raises(ValueError):
            B.page(*tables, **bad)


def test_statistics(tables):
    c, _ = tables
    assert {(r["dim"], r["value"]): r["n"] for r in B.distribution(c).collect()} == {("L1", "A.Bug"): 4, ("L1", "C.咨询"): 3, ("severity", "P0"): 1, ("severity", "P3"): 6, ("L2", "性能"): 4, ("L2", "账号"): 4}
    assert B.rates(c).first().asDict() == {"total": 7, "p0": 1, "classified": "100.0%", "pending": "0.0%"}
    assert B.rates(c.where("false")).first().classified == "—"
    assert [r.tag for r in B.top_tags(c, 1).collect()] == sorted(["性能", "账号"])[:1]
    with pytest.raises(ValueError):
        B.trend(c, "week")


@pytest.mark.parametrize(
    ("query", "rest", "platform", "version", "device"),
    [
        ("查看 3.5.0 mac 闪退", "查看 闪退", "Mac", "3.5.0", None), ("win3.6.0 卡", "卡", "Win", "3.6.0", None), ("安卓端 Pixel 8 乱码", "乱码", "Android", None, "Pixel8"), ("iOS", "反馈", "iOS", None, None), ("MacBook Pro 18,3", "反馈", None, None, "MacBookPro18,3"), ("语音", "语音", None, None, None), ("小程序 v2.1.0.20 卡", "卡", "小程序", "2.1.0.20", None), ("Mac OS 端 4.0 慢", "慢", "Mac", "4.0", None),
        ("and端 iphone15,2", "反馈", "Android", None, "iphone15,2"), ("version 3 mate random winner", "version 3 mate random winner", None, None, None), ("1.2.3.4.5.6 a1.2", "1.2.3.4.5.6 a1.2", None, None, None),
    ],
)
def test_query_parts(query, rest, platform, version, device):
    text, f = I.parse_query(query)
    assert (text, f.platform, f.appversion, f.device_name) == (rest, platform, version, device)
    assert I.parse_query("ios", FL.Filters(platform="Win"))[1].platform == "Win,iOS"


def test_intent_reply_and_plan():
    got = I.read_intent('```json\n{"must": [["语音 ", "语音"], ["' + "x" * 31 + '"], "投诉"], "exclude": "a"}\n```')
    assert got == S.Intent([["语音"], ["投诉"]], [], ["a"])
    clean = I.text_intent(got)
    assert clean.must[1][0] == "不好" and "投诉" not in clean.must[1]
    topics = {"voice": ["语音输入", "语音"], "typing": ["输入", "打字"], "skin": ["皮肤"]}
    plan = I.topic_plan("语音输入不好用", S.Intent(must=[["录入", "评价"], ["耳机"]]), topics)
    assert plan.must[0] == topics["voice"] and ["录入"] in plan.must and ["耳机"] in plan.must and "故障" in plan.must[-1] and topics["typing"] not in plan.must
    assert I.rank_topics("打字和皮肤", topics) == ["typing", "skin"] and I.topic_plan("?", S.Intent(should=[["换皮肤"]]), topics).must == [topics["skin"]]
    assert I.topic_plan("天气", None) is None
    for bad in ("no json", "[]", "{}"):
        with pytest.raises(ValueError):
            I.read_intent(bad)
    assert I.read_patterns('{"patterns": ["a", "("], "logic": "AND"}').groups == [(["a"], "AND")]


def test_smart_search_ways(tables):
    assert I.smart_search(*tables, "Win端 反馈")[1] == "metadata_only"
    found, way = I.smart_search(*tables, "语音 用不了")
    assert way == "structured_intent" and ids(found) == ["c1", "c6"]
    found, way = I.smart_search(*tables, "奇怪", ask_intent=lambda q: "broken", ask_patterns=lambda q: '{"groups": [{"patterns": ["垃圾"]}]}')
    assert way == "regex" and ids(found) == ["c6"]
    found, way = I.smart_search(*tables, "谢谢")
    assert way == "query_keywords" and ids(found) == ["c1"]
    with pytest.raises(ValueError):
        I.smart_search(*tables, " ")
