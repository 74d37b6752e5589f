import pytest

from lexiform import api
from lexiform.operators import dynamic, index
from lexiform.sources import stores

NONE = "key long, name string, aliases array<string>"


def records(spark, entities, areas=()):
    e = spark.createDataFrame([(i, n, d, []) for i, (n, d) in enumerate(entities)], "key long, name string, domain string, aliases array<string>")
    return stores.registry(e, spark.createDataFrame([(i, a, []) for i, a in enumerate(areas)], NONE), spark.createDataFrame([], NONE))


def made(spark, sentences, entities, text, lists=None, areas=(), item=None, **options):
    source = {"intents": {"HassSet": {"data": [{"sentences": sentences, **(item or {})}]}}, "lists": lists or {}}
    queries = api.prepared_queries(spark.createDataFrame([(1, text), (2, "nothing of the kind")], "qid long, text string"))
    rows = dynamic.query_candidates(queries, dynamic.template_rows(spark, {"built_in": source}), records(spark, entities, areas), **options)
    return [r for r in rows.collect() if r.qid == 1]


def test_numbers_of_a_range(spark):
    got = made(spark, ["set [the] {name} temperature to {temperature}"], [("living room", "climate")], "set living room temperature to 27", {"temperature": {"range": {"from": 0, "to": 50}}}, cap=1)
    assert [(r.text, r.slots) for r in got] == [("set living room temperature to 27", {"name": "living room", "temperature": "27"})]


@pytest.mark.parametrize(("said", "meant"), [("20.5", "20.5"), ("20,5", "20.5")])
def test_fractions_keep_what_was_said(spark, said, meant):
    lists = {"temperature": {"range": {"type": "temperature", "from": 0, "to": 100, "fractions": "halves"}}}
    got = made(spark, ["set [the] {name} temperature to {temperature}"], [("living room", "climate")], f"set living room temperature to {said}", lists, cap=1)
    assert [(r.text, r.slots["temperature"]) for r in got] == [(f"set living room temperature to {said}", meant)]


def test_numbers_outside_a_range_give_nothing(spark):
    assert made(spark, ["set {name} to {level}"], [("lamp", "light")], "set lamp to 70", {"level": {"range": {"from": 0, "to": 50}}}) == []


def test_several_numbers_need_their_anchor(spark):
    lists = {"brightness": {"range": {"from": 0, "to": 100}}}
    got = made(spark, ["set {name} brightness to {brightness}"], [("lamp 2", "light")], "set lamp 2 please and then its brightness to 70", lists)
    assert {r.slots["brightness"] for r in got} == {"70"}


def test_values_are_recovered_and_scoped(spark):
    entities = [("Bedroom Window", "cover"), ("Bedroom Light", "light"), ("Kitchen Light", "light")]
    got = made(spark, ["turn off [the] {name}"], entities, "turn off the bedrom windw")
    assert {r.slots["name"] for r in got} == {"Bedroom Window"} and {r.registry_retrieval for r in got} == {"anchored"}
    only = made(spark, ["turn off [the] {name}"], entities, "turn off the bedroom window", item={"slots": {"domain": "light"}})
    assert {r.slots["name"] for r in only} <= {"Bedroom Light"}


def test_lists_wildcards_and_the_gate(spark):
    lists = {"color": {"values": [{"in": "red", "out": "ff0000"}, "blue"]}, "item": {"wildcard": True}}
    got = made(spark, ["paint {name} {color}"], [("wall", "x")], "paint wall red", lists, cap=1)
    assert [(r.text, r.slots["color"], r.slots_raw["color"]) for r in got] == [("paint wall red", "ff0000", "red")]
    free = made(spark, ["add {item} to [my] list"], [], "add milk to list", lists)
    assert {r.text for r in free} == {"add item to list", "add item to my list"} and free[0].wildcard_slots == ["item"]
    assert made(spark, ["open every curtain {name}"], [("wall", "x")], "paint wall red") == []


def test_dynamic_candidates_win_what_the_static_index_lacks(spark):
    engine = api.Engine(spark)
    engine.load_candidates(spark.createDataFrame([(0, "turn on everything", "HassTurnOn"), (1, "add item to list", "HassListAddItem")], "cid long, text string, intent string").selectExpr("*", "if(cid = 1, array('item'), array()) as wildcard_slots", "if(cid = 1, map('item', 'item'), map()) as slots", "if(cid = 1, 'add to list', 'turn on everything') as literal_text"), "en")
    source = {"intents": {"HassTurnOff": {"data": [{"sentences": ["turn off [the] {name}"]}]}}}
    asked = spark.createDataFrame([(1, "turn off the bedrom window"), (2, "add rye bread to list"), (3, "")], "qid long, text string")
    made_ = dynamic.query_candidates(api.prepared_queries(asked), dynamic.template_rows(spark, {"x": source}), records(spark, [("bedroom window", "cover"), ("bedroom light", "light")]))
    ranked, decided = engine.rank_and_evaluate(asked, "en", made_)
    top = {r.qid: r for r in ranked.where("rank = 1").collect()}
    assert top[1].text == "turn off the bedroom window" and top[1].slots == {"name": "bedroom window"}
    assert top[2].rehydrated == "add rye bread to list" and top[2].replacements == {"item": "rye bread"} and top[2].char == top[2].fuzzy == 1
    assert {r.qid: r.accepted for r in decided.collect()} == {1: True, 2: True}
    routed = {r.qid: (r.route, r.delegated) for r in engine.route(asked, "en").collect()}
    assert routed[2] == ("execute", "add rye bread to list") and routed[1][0] == "fallback"
    engine.close()


def test_accepted_decisions_are_remembered(spark, monkeypatch):
    engine = api.Engine(spark)
    engine.load_candidates(spark.createDataFrame([(0, "turn on everything", "HassTurnOn"), (1, "turn off everything", "HassTurnOff")], "cid long, text string, intent string"), "en")
    asked = spark.createDataFrame([(1, "Turn on everything!"), (2, "turn on everything"), (3, "what is this")], "qid long, text string")
    ranked = []
    real = engine.rank_and_evaluate
    monkeypatch.setattr(engine, "rank_and_evaluate", lambda q, language: ranked.append(q.count()) or real(q, language))
    first = {r.qid: r.accepted for r in engine.evaluate(asked, "en").collect()}
    again = {r.qid: r.accepted for r in engine.evaluate(asked, "en").collect()}
    assert first == again == {1: True, 2: True, 3: False} and ranked == [2, 1]
    assert engine.diagnostics().first().remembered == 1 and engine.prepare(["en"]).first().candidates == 2
    made_ = []
    assert engine.snapshot("en", lambda: made_.append(1) or "x") == engine.snapshot("EN", lambda: made_.append(1) or "y") == "x" and made_ == [1]
    engine.generations.bump("registry")
    assert engine.snapshot("en", lambda: "z") == "z"
    engine.evaluate(asked, "en")
    assert ranked == [2, 1, 2]
    engine.close()


def test_fixed_sentences_are_left_to_the_index(spark):
    source = {"intents": {"A": {"data": [{"sentences": ["good night", "good [old] day", "{area} news"]}]}}}
    rows = dynamic.template_rows(spark, {"x": source}, area_only=False).collect()
    assert [r.template for r in rows] == ["good [old] day"]
    assert dynamic.template_rows(spark, {"x": source}, literal_only=False).collect()[0].template == "{area} news"
    assert index.candidates(spark.createDataFrame([(0, " ", "A")], "cid long, text string, intent string")).count() == 0
