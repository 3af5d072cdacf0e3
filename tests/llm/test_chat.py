import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyframe.llm import chat

EVENTS = "conv_id long, seq long, msg long, kind string, role string, text string"


def folded(spark, events):
    out = chat.fold(spark.createDataFrame(events, EVENTS)).orderBy("conv_id", "pos").collect()
    return [(r["conv_id"], r["role"], r["text"]) for r in out]


def test_deltas_edits_and_regenerations(spark):
    log = [(1, 1, 1, "begin", "user", "hel"), (1, 2, 1, "delta", None, "lo"), (1, 3, 2, "begin", "assistant", None),
           (1, 4, 2, "delta", None, "bad"), (1, 5, 3, "begin", "user", "why"), (1, 6, 2, "regenerate", None, None),
           (1, 7, 2, "delta", None, "go"), (1, 8, 2, "delta", None, "od"), (1, 9, 1, "edit", None, "hi"),
           (2, 1, 1, "begin", "user", "x"), (2, 2, 2, "begin", "assistant", "y"), (2, 3, 2, "delete", None, None)]
    assert folded(spark, log[::-1]) == [(1, "user", "hi"), (1, "assistant", "good"), (2, "user", "x")]


def test_messages_after_a_regeneration_stay(spark):
    log = [(1, 1, 1, "begin", "assistant", "a"), (1, 2, 1, "regenerate", None, None), (1, 3, 1, "delta", None, "b"),
           (1, 4, 2, "begin", "user", "c")]
    assert folded(spark, log) == [(1, "assistant", "b"), (1, "user", "c")]


def round_trip(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.render(chat.fold(chat.turn_events(df))))
    return {r["conv_id"]: r for r in back.collect()}


HARD = st.text(alphabet=list("<|\\>im_startend\n aé😀"), max_size=30)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\\n<|im_start|>", "x\ny", ""]), HARD), min_size=1, max_size=8))
def test_round_trip_of_control_strings(spark, turns):
    got = round_trip(spark, [(5, k, role, text) for k, (role, text) in enumerate(turns)])[5]
    assert [(t["role"], t["text"]) for t in got["turns"]] == turns
    assert [t["loss"] for t in got["turns"]] == [role == "assistant" for role, _ in turns]
    assert got["formatted"].count("<|im_start|>") == len(turns)


def test_nulls_ties_and_repeats(spark):
    got = round_trip(spark, [(None, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "b"), (1, None, "assistant", "late")])
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("", "")]
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", "b"), ("user", "b"), ("assistant", "late")]
    assert round_trip(spark, []) == {}


def test_query_shape(spark):
    from tallyframe.llm.queries import CONTROL_TEXT, QUERIES
    df = QUERIES["op10_chat_format"](spark, "/root/testdata/sf0.001")
    own = df.where("conv_id = -1").first()
    said = CONTROL_TEXT
    assert own["n_turns"] == 2 and own["loss_chars"] == len(said)
    assert own["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert own["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
