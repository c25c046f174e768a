import random
import string

import pytest
from cases import prose

from vectrove.llm.secrets import novel_spans

ALPHABETS = {
    "digits": string.digits,
    "upper hex": "0123456789ABCDEF",
    "lower": string.ascii_lowercase,
    "base32": string.ascii_uppercase + "234567",
    "lower and digits": string.ascii_lowercase + string.digits,
    "upper and digits": string.ascii_uppercase + string.digits,
    "letters": string.ascii_letters,
    "letters and digits": string.ascii_letters + string.digits,
    "base64": string.ascii_letters + string.digits + "+/",
}
SOURCE = "def connect(self, config):\n    if config.endpoint is None:\n        raise ValueError(config)\n    return self.pool.open(config.endpoint, timeout=30)\n"


@pytest.mark.parametrize("alphabet", ALPHABETS)
@pytest.mark.parametrize("n", [20, 40, 64, 128, 200, 400])
def test_random_keys_are_found_at_any_length(alphabet, n):
    r = random.Random(f"{alphabet} {n}")
    found = 0
    for i in range(40):
        key = "".join(r.choices(ALPHABETS[alphabet], k=n))
        before, after = [("client_key: ", ""), (SOURCE + "client_key: ", "\n" + SOURCE)][i % 2]
        found += novel_spans(before + key + after, []) == [("novel", len(before), len(before) + n)]
    assert found >= (36 if n < 40 else 39)


@pytest.mark.parametrize("word", ["authorization_config_endpoint_1", "a" * 40, "-" * 60, "0" * 30, "12" * 40, "einkeitlichenzuverschkeitlich", "getUserAuthenticationProviderFactory", "/usr/share/config/service/endpoint", "default_connection_timeout_seconds", "abcdefghijklmnopqrstuvwxyz"])
def test_words_paths_and_runs_are_not_keys(word):
    text = f"{prose(3, 40)} keit lichen zuver schkeit client_key: {word} {prose(4, 40)}"
    assert novel_spans(text, []) == []
