import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.llm import personal
from riskloom.llm.personal import find_personal, judged_terms, personal_types, sanitise, sanitised

GIVEN, ORDINARY = frozenset({"Hanna", "Jan", "Zoë"}), frozenset({"The", "On", "Please", "Road", "Thanks"})


def kinds(text):
    return {k for _, _, k in find_personal(text, GIVEN, ORDINARY)}


@pytest.mark.parametrize("text, want", [
    ("write to a.b+c@mail.example.org.", {"email"}), ("cc jose (at) corp.example", {"email"}), ("x y[at]box[dot]test z", {"email"}), ("mail to bob at example dot com", {"email"}),
    ("cc PAVEL＠MAIL.EXAMPLE", {"email"}), ("git@git.example:a/b.git", set()), ("ssh://git@git.example/a", set()), ("Scope @a/b needs", set()), ("stash@{2}", set()), ("call in @x.policy", set()), ("failed at 4 a.m. on host", set()),
    ("call +49 30 23125 379 now", {"phone"}), ("0049 (0)30 23125379", {"phone"}), ("tel=0049(0)3023125379", {"phone"}), ("(905) 555-0172.", {"phone"}), ("01.99.00.84.29", {"phone"}), ("020 7946 0604", {"phone"}),
    ("916-555-0193 ext. 18", {"phone"}), ("14335550152", {"phone"}), ("+442079460722", {"phone"}), ("tel=618-555-0159ext.95", {"phone"}), ("+49 30\n23125 379", {"phone"}),
    ("Build 4648355625 passed", set()), ("Took 1 235 580 ms", set()), ("10.231.130.7:8080", set()), ("Trace 48492879-4034-4832-a972-688734917897", set()), ("from 4.66.78 to 4.66.78.1", set()),
    ("SSN 948-48-1797", {"id_number"}), ("social security number 927 42 7986 in", {"id_number"}), ("passport no. X7040709", {"id_number"}), ("passport QK094723", {"id_number"}), ("national id 3104-0015-06", {"id_number"}),
    ("tax number 00/968/08679", {"id_number"}), ("ID card L60X31418", {"id_number"}), ("driver licence Q365-8891-663", {"id_number"}), ("passport control", set()),
    ("at Jelasasstraße 364, 99368 Port Arlen", {"address"}), ("Kanalolweg 356.", {"address"}), ("to 180 Jivigir St., Apt 19, Port Arlen", {"address"}), ("Calle de Tarunek 361, 8º B, Velden", {"address"}),
    ("338 Old Mill Road", {"address"}), ("307B Foxglove Avenue, Velden 10979", {"address"}), ("144 rue des Mulakars, 54043 Sainte-Ombre", {"address"}), ("Flat 29, 150 Larkfield Lane, Port Arlen", {"address"}), ("step 24 of the road map", set()),
    ("Thanks to Hanna Tajevos.", {"name"}), ("by Tajevos, Jan for", {"name"}), ("owner=Zoë_Jufovi x", {"name"}), ("On Jan. 16 the", set()), ("Hanna Harbor release", set()), ("Hanna", set()), ("Silver Heron release", set()),
    ("by: Hanna Tajevos <hanna@x.example>", {"name", "email"}), ("hanna.tajevos@x.example", {"email"}), ("", set()), ("x" * 200_000, set()),
])
def test_forms(text, want):
    assert kinds(text) == want


@pytest.mark.parametrize("text, want", [("thanks to lena fajazer for", set()), ("thanks to hanna fajazer for", {"name"}), ("thanks to HANNA FAJAZER.", {"name"}), ("by FAJAZER, HANNA", {"name"}), ("as hanna really said", set()), ("HANNA REALLY", set()), ("hanna.fajazer said", set()), ("user hanna fajazer@x.example", {"email"})])
def test_names_in_one_case(text, want):
    assert {k for _, _, k in find_personal(text, GIVEN, ORDINARY, frozenset({"really", "said"}))} == want


def test_the_rest_of_the_text_stays():
    text = "Ask Hanna Tajevos (hanna@x.example), or 020 7946 0604.\nDone"
    assert sanitise(text, find_personal(text, GIVEN, ORDINARY)) == "Ask [NAME] ([EMAIL]), or [PHONE].\nDone"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("Hanna Jn.@-+0123456789(),\nabRoad "), max_size=80))
def test_spans_never_overlap(text):
    spans = find_personal(text, GIVEN, ORDINARY)
    assert all(a < b for a, b, _ in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_names_are_learned_from_the_corpus(spark):
    certain = [f"Signed-off-by: {g} Family{i} <a@b.example>" for i in range(6) for g in ("Hanna", "Jan")]
    plain = ["On Jan. 4 the gate Failed. The Silver Heron release."] * 40 + ["The Jan Kubaso report. Thanks to Hanna Tajevos.", None, ""]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(certain + plain)], "id long, text string, sanitised_text string")
    given, ordinary, _ = judged_terms(df.select("text"))
    assert given == {"Hanna", "Jan"} and {"The", "On", "Silver"} <= ordinary
    found = {(r.id, r.pii_type) for r in personal_types(df, ["id"]).collect()}
    assert (52, "name") in found and (12, "name") not in found and len([f for f in found if f[1] == "email"]) == 12
    clean = {r.id: r.sanitised_text for r in sanitised(df, "text").collect()}
    assert clean[52] == "The [NAME] report. Thanks to [NAME]." and clean[53] is None and clean[54] == "" and len(clean) == 55
    assert personal_types(df.limit(0), ["id"]).count() == 0


def test_certain_names_are_found_whatever_the_list():
    none = frozenset()
    assert find_personal("x\nSigned-off-by: Please Tajevos <p@x.example>", none, ORDINARY) == [(17, 31, "name"), (33, 44, "email")]
    assert find_personal("owner=Silver Heron release", none, none) == []


def test_rare_given_names_are_joined(spark, monkeypatch):
    monkeypatch.setattr(personal, "LEAST_NAME", 0.2)  # as 1e-5 and 1e-4 are for many more names and words
    monkeypatch.setattr(personal, "LEAST_WORD", 0.2)
    certain = [f"Signed-off-by: {g} Family{i} <a@b.example>" for i, g in [*enumerate(["Hanna"] * 20), (20, "Zoran"), (21, "Zoran")]]
    plain = ["The gate Failed again in the Silver release."] * 40 + ["Thanks to Zoran Kubaso.", "thanks to zoran kubaso.", "ZORAN KUBASO", None, ""]
    df = spark.createDataFrame(list(enumerate(certain + plain)), "id long, text string")
    assert judged_terms(df.select("text"))[0] == {"Hanna"}
    assert {r.id for r in personal_types(df, ["id"]).collect() if r.pii_type == "name"} == {*range(22), 62, 63, 64}
    clean = {r.id: r.sanitised_text for r in sanitised(df, "text").collect()}
    assert [clean[i] for i in range(62, 67)] == ["Thanks to [NAME].", "thanks to [NAME].", "[NAME]", None, ""] and len(clean) == 67


def test_shapes_of_identity_numbers_are_learned(spark):
    """A shape that no pattern has: cues stand before it often enough to tell it without one; a shape of build numbers stays."""
    cued = [f"passport no. {i:03d}-XK-{i:04d} of the user" for i in range(101, 121)]
    plain = [f"Build {i:03d}-{i:04d} passed" for i in range(101, 161)] + ["ID card 160-0160 seen", "Seen 555-QR-7788 again", "Seen 555-7788 again"]
    df = spark.createDataFrame(list(enumerate(cued + plain)), "id long, text string")
    assert "#999-AA-9999" in judged_terms(df.select("text"))[0] and "#999-9999" not in judged_terms(df.select("text"))[0]
    found = {r.id for r in personal_types(df, ["id"]).collect() if r.pii_type == "id_number"}
    assert found == {*range(20), 80, 81}
    clean = {r.id: r.sanitised_text for r in sanitised(df, "text").collect()}
    assert clean[81] == "Seen [ID_NUMBER] again" and clean[82] == "Seen 555-7788 again"
    again = df.unionByName(df.filter("id < 80").join(spark.range(1, 30).select(F.col("id").alias("k")), F.lit(True)).select((F.col("id") + 1000 * F.col("k")).alias("id"), "text"))
    assert {r.id for r in personal_types(again, ["id"]).collect() if r.pii_type == "id_number" and r.id < 1000} == found
