from loomlint import config


def test_precedence():
    c = config.load(user={"sla": "L2", "scan": {"include": ["a"]}}, project={"sla": "nonsense", "scoring": {"threshold": 80}}, overrides={"locale": "zh", "scan": {"exclude": ["b"], "include": None}})
    assert c["sla"] == "L2" and c["locale"] == "zh" and c["scoring"] == {"threshold": 80} and c["scan"] == {"include": ["a"], "exclude": ["b"]}


def test_levels():
    assert config.recommended_sla({}) == "L1" and config.recommended_sla({"local": {"model": "m"}}) == "L2" and config.recommended_sla({"remote": {"api_key": "k"}}) == "L3"
    assert config.sla_errors("L3", {"remote": {"model": "m"}}) == ["L3 requires remote.api_key"] and not config.sla_errors("L1", {})
    assert config.stages("L2") == ["structural", "embedding"] and config.should_degrade(80, 100) and not config.should_degrade(79, 100)
    assert config.key_format("KEYS-8F3A-K9D2-P7X2-Q4M6", "KEYS") and not config.key_format("KEYS-0000-1111-OOOO-LLLL", "KEYS")
