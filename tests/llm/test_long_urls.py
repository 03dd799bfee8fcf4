"""op8_url_rules on URLs with many labels, segments and parameters."""

from larkspur.llm import url_rules


def test_a_late_token_is_matched_and_mined(spark):
    deep = lambda k, last: f"http://{'.'.join(f'h{i}' for i in range(k, k + 30))}.com/" + "/".join(f"s{chr(97 + j)}x{k * 31 + j}y" for j in range(2)) + "/" + "/".join(f"d{k}q{chr(97 + j)}" * 2 for j in range(25)) + f"/{last}"
    rule = url_rules.Rule(("path:casino",), 1.0, 0.1)
    urls = [(1, deep(1, "casino")), (2, deep(2, "fine")), (3, "http://a.b/?" + "&".join(f"p{chr(97 + i)}={i}" for i in range(26)) + "&casino=1")]
    rules = [rule, url_rules.Rule(("param:casino",), 0.9, 0.1)]
    got = {r.page_id: r.verdict for r in url_rules.judge(spark.createDataFrame(urls, "page_id long, url string"), rules, fixed=[]).collect()}
    assert got == {1: "block", 2: "allow", 3: "block"}
    letters = "abcdefghijklmnopqrstuvwxyz"
    unique = lambda i, j: "u" + letters[i % 26] + letters[i // 26 % 26] + letters[j]
    rows = [("http://x.com/" + "/".join(unique(i, j) for j in range(26)) + ("/casino" if i % 5 == 0 else "/fine"), i % 5 == 0) for i in range(300)]
    assert ("path:casino",) in {r.tokens for r in url_rules.mine(spark.createDataFrame(rows, "url string, block boolean"))}
    assert "host:h1" in url_rules.tokens(deep(1, "x"))
