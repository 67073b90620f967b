import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from harrow.llm import sentences as S

EN = [
    "Dr. Kolb and Prof. A. B. Venn led the survey of 12 farms in N.E. Torda.",
    "Yields rose by .58 units per year (s.d. 0.95).",
    "The herders kept ducks, goats, etc.",
    "Work began at 6 a.m. and ended by 10 p.m. on most farms.",
    "One respondent said: \"The rains came late. We sold the goats.\"",
    "“We plant teff first. Then we wait,” explained a farmer near Torda.",
    "\"Is it worth it?\" asked most growers.",
    "“Nobody told us!” was a common answer.",
    "Earlier work by P. L. Venn et al. found little (cf. Fig. 3).",
    "mRNA levels of Z. exempla rose after 3 days.",
    "Results: costs fell by 3.5 percent, i.e. a lot.",
    "Uptake was low at first ... but rose to 7% by 2000.",
    "In Jan. 2006 the U.N.-style ration was cut.",
    "What explains the low uptake of drip lines?",
    "(C) 2004, Venn Publ. Co., Torda.",
]
DE = ["Am 3. Mai 2015 wurden 9 Parzellen angelegt, z. B. mit Hirse.", "Im 22. Jahr stieg der Humusgehalt.", "„Der Regen kam spät. Wir warteten“, sagte eine Bäuerin.", "Die Kosten sanken, d. h. um 9 % weniger als 2012."]
RU = ["Обследовано 8 участков, т. е. 9 % площади.", "«Дождь пришёл поздно. Мы ждали», — сказал фермер.", "По данным проф. B. K. Ольбрека, урожай вырос в 1996 г. при поливе."]
ZH = ["一位农民说：“雨来得太晚。我们卖了3只山羊。”", "“值得吗？”多数受访者（n=8）这样问。", "平均产量为3.4吨，比对照高31%。", "为什么采用率仍然很低？"]
JA = ["ある農家は「雨が遅かった。山羊を5頭売った。」と述べた。", "なぜ導入しないのか？", "平均収量は1.2トンで、対照より高かった。"]
HI = ["एक किसान ने कहा, \"बारिश देर से आई। हमने 6 बकरियाँ बेच दीं।\"", "डॉ. Venn के अनुसार 8 किसानों ने विधि अपनाई।"]
AR = ["قال مزارع: «تأخر المطر. بعنا 8 رؤوس».", "لماذا يبقى استخدام الري منخفضا؟"]
TH = ["ระบบน้ำหยดช่วยประหยัดน้ำได้ร้อยละ48", "เกษตรกร349รายใช้ปุ๋ยอินทรีย์"]


def cut(text):
    at = S.starts(text)
    return [text[a:b].strip() for a, b in zip(at, [*at[1:], len(text)])]


@pytest.mark.parametrize("group", [EN, DE, RU, HI, AR, TH])
def test_joined_sentences_come_apart_again(group):
    rng = random.Random(4)
    for _ in range(60):
        chosen = rng.sample(group, min(len(group), rng.randint(1, 6)))
        text = rng.choice([" ", "  "]).join(chosen)
        assert cut(text) == chosen


@pytest.mark.parametrize("group", [ZH, JA])
def test_scripts_without_blanks(group):
    rng = random.Random(5)
    for _ in range(40):
        chosen = rng.sample(group, rng.randint(1, len(group)))
        assert cut("".join(chosen)) == chosen


def test_upper_and_lower_case_texts():
    plain = ["Yields fell by 9% in 2004.", "Did compost help?", "Dr. Venn led the survey."]
    for change in (str.upper, str.lower):
        assert cut(change(" ".join(plain))) == [change(x) for x in plain]


def test_missing_blank_and_missing_mark():
    assert cut("Costs fell as well.In Torda, yields rose (P < 0.05).211 plots were sown") == [
        "Costs fell as well.",
        "In Torda, yields rose (P < 0.05).",
        "211 plots were sown",
    ]


def test_line_breaks_alone_end_nothing():
    assert len(cut("a long line\nthat goes\n\non and on")) == 1


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One. Two."), (5, "x" * 200_000), (4, "One. Two."), (None, "A b.")]
    df = spark.createDataFrame(rows, "id bigint, abstract string").selectExpr("*", "1 as sentence", "2 as text")
    got = S.segment(df).collect()
    assert sorted((r["id"] or 0, r["start_pos"]) for r in got) == [(0, 1), (4, 1), (4, 1), (4, 6), (4, 6), (5, 1)]
    assert S.segment(df.where("id < 0")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB 1.!?…。\"“”«»()\n’'กข,:")), max_size=80))
def test_every_character_is_in_one_sentence(text):
    at = S.starts(text)
    assert at == sorted(set(at))
    assert bool(at) == bool(text.strip())
    if at:
        assert text[: at[0]].strip() == ""
        assert all(not text[k].isspace() for k in at)


def test_terminators_of_any_script():
    khmer, brahmi = ["ខ្ញុំទៅ។", "គាត់មក។", "ល្អ។"], ["𑀅𑀓𑁇", "𑀆𑀓𑁇", "𑀇𑀓𑁇"]
    assert cut(" ".join(khmer)) == khmer and cut(" ".join(brahmi)) == brahmi
    assert len(S.STERM) >= 150


def test_long_quotations_and_brackets_stay_whole():
    inner = "It rained all day. We left the field. " * 30
    quoted = [f'He said: "{inner}"', "Then they went.", "All was good."]
    assert cut(" ".join(quoted)) == quoted
    bracket = ["The trial (" + "see the first plot. Also the second one. " * 12 + ") was dry.", "It ended."]
    assert cut(" ".join(bracket)) == bracket
    inches = ['A 5" pipe broke.', 'She said "It is. Fine."', "Then she left.", 'The 6" one held.']
    assert cut(" ".join(inches)) == inches
    lone = ['The "open quotation began here.', "It never ended.", 'He said "We wait. Then we go."', "They did."]
    assert cut(" ".join(lone)) == lone


def test_abbreviations_hold_for_their_language():
    assert cut("They sold the car to the rep. The next day it rained.") == ["They sold the car to the rep.", "The next day it rained."]
    assert cut("We met Rep. Smith and Dr. Kolb. They left.") == ["We met Rep. Smith and Dr. Kolb.", "They left."]
    assert cut("He said no. 12 farmers of the village agreed.") == ["He said no.", "12 farmers of the village agreed."]
    assert cut("The plots no. 12 and no. 13 were dry. It was so.") == ["The plots no. 12 and no. 13 were dry.", "It was so."]
    assert cut("Los datos de la Sra. Vega son de 2004. La Dra. Ruiz los leyó.") == ["Los datos de la Sra. Vega son de 2004.", "La Dra. Ruiz los leyó."]
