"""Verbatim copies are found whatever their literal words."""

from tideframe.llm import decontam

FILL = "some clean words that say nothing much about anything at all "
ITEMS = [
    "What is 12 + 7 - 3 + 45 - 6 + 9 ?",
    "3 17 29 41 53 67 71 83 97 101 113 127",
    "Paris London Berlin Madrid Rome Vienna Lisbon Dublin Oslo Athens",
    "Der Hund des Nachbarn jagt die Katze durch den Garten der Familie Schmidt",
    "Who wrote the book about Emma",
    "Name two primes",
    "What is the capital of France",
    "Maria bought 12 apples 15 pears 18 plums 21 figs and 24 dates",
    "What is 17 x 24 ?",
    "Compute 12 + 34 + 56 + 78 + 90.",
]


def flags(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return [(r.item_ids, r.reparameterised, r.covered_words) for r in decontam.flag(docs, benchmark).orderBy("doc_id").collect()]


def test_verbatim_copies(spark):
    texts = [x for item in ITEMS for x in (item, FILL + item + " " + FILL, FILL + '"' + item + '" ' + FILL)]
    for i, (ids, other, covered) in enumerate(flags(spark, texts, ITEMS)):
        assert ids == [i // 3] and not other and covered > 0
    assert flags(spark, [FILL * 3], ITEMS) == [([], False, 0)]


def test_other_numbers_are_no_copy(spark):
    item = "3 17 29 41 53 67 71 83 97 101 113 127"
    assert flags(spark, ["4 18 30 42 54 68 72 84 98 102 114 128"], [item]) == [([], False, 0)]


def test_first_word_of_an_item_inside_a_sentence(spark):
    item, other = "Janet sells eggs at the market for 16 dollars", "Janet sells eggs at the market for 23 dollars"
    assert flags(spark, ["they say that " + other + " every day"], [item]) == [([0], True, 9)]
