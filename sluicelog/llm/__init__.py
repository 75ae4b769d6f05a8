"""Operations for preparing language-model training data. Nothing else in the library imports this subpackage."""

from importlib import import_module

MODULES = ["langid", "fingerprints", "pii", "bpe", "near_dups", "toxicity", "secrets", "url_rules", "decontamination", "warc"]
QUERIES, SQL = {}, {}
for _name in MODULES:
    _module = import_module(f"{__name__}.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
