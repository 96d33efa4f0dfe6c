import json

from answerloom.functions.nested import response_fields


def test_response_fields(spark):
    def msg(m, **root):
        return json.dumps({"choices": [{"message": m}], **root})

    cases = [
        (msg({"content": "A", "reasoning": "R"}), ("A", "R", None)),
        (msg({"content": [{"type": "text", "text": "A"}, "B", {"x": 1}, {"content": "C"}]}),
         ("ABC", "", None)),
        (msg({"content": {"parts": [{"text": "P"}]}}), ("P", "", None)),
        (msg({"content": {"id": "7", "odd": "O"}}), ("O", "", None)),
        (msg("plain"), ("plain", "", None)),
        (msg({"content": "", "thinking": "T"}), ("T", "T", None)),
        (msg({"content": None}, output_text="Z"), ("Z", "", None)),
        (json.dumps({"choices": [{"text": "X"}], "thinking": "Q"}), ("X", "Q", None)),
        (json.dumps({"choices": []}), (None, None, "no choices")),
        (json.dumps({"choices": [{}]}), (None, None, "no text")),
        ('{"choices": [', (None, None, "not JSON")),
        ('{"choices": [{"text": "X"}]} tail', (None, None, "not JSON")),
    ]
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(cases)], "i int, raw string")
    rows = df.select("i", response_fields("raw").alias("f")).orderBy("i").select("f.*").collect()
    assert [tuple(r) for r in rows] == [want for _, want in cases]
