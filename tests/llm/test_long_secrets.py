from claimloom.llm import pii


def test_long_keys_are_proposed_and_redacted(spark):
    for n in (150, 201, 1000):
        key = ("a1B2c3D4e5F6g7H8" * 100)[:n]
        text = f"api_key = '{key}' is set"
        assert ("secret", text.index(key), text.index(key) + n) in pii.proposals(text)
        assert key not in pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"]
