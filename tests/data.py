"""Small reference sets and requests."""

import json

from pentad.config import FEATURES

SIDE = ", ".join(f"{f} smallint" for f in FEATURES)


def vector(**dims):
    out = [0] * 14
    for name, v in dims.items():
        out[int(name[1:])] = v
    return out


def refs(spark, rows):
    """(vector or value of feature 0, label) pairs; ids in order."""
    full = [(i, *(v if isinstance(v, list) else vector(f0=v)), label) for i, (v, label) in enumerate(rows)]
    return spark.createDataFrame(full, f"ref_id long, {SIDE}, label int")


def queries(spark, vectors):
    return spark.createDataFrame([(i, *v) for i, v in enumerate(vectors)], f"query_id long, {SIDE}")


def request(**changes):
    """The body of the golden request with parts replaced; a part set to KeyError is left out."""
    body = {
        "id": "tx-test",
        "transaction": {"amount": 384.88, "installments": 3, "requested_at": "2026-03-11T20:23:35Z"},
        "customer": {"avg_amount": 769.76, "tx_count_24h": 3, "known_merchants": ["MERC-009", "MERC-001"]},
        "merchant": {"id": "MERC-001", "mcc": "5912", "avg_amount": 298.95},
        "terminal": {"is_online": False, "card_present": True, "km_from_home": 13.7},
        "last_transaction": {"timestamp": "2026-03-11T20:08:35Z", "km_from_current": 18.8},
    }
    for name, value in changes.items():
        part, _, field = name.partition("__")
        at, key = (body[part], field) if field else (body, part)
        if value is KeyError:
            del at[key]
        else:
            at[key] = value
    return json.dumps(body)
