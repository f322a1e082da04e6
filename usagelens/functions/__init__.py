from usagelens.functions.jsvalues import (
    js_round,
    money_sum,
    to_int,
    to_num,
)
from usagelens.functions.models import arn_user, backfill_model_id, list_price, normalize_model

__all__ = [
    "arn_user", "backfill_model_id", "js_round", "money_sum",
    "list_price", "normalize_model", "to_int", "to_num",
]
