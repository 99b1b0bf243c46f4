from lossledger.functions.money import avg_round, count_if, money, pct, round_div, sum_money
from lossledger.functions.pick import pick, pick_sql

__all__ = ["money", "round_div", "avg_round", "sum_money", "pct", "count_if", "pick", "pick_sql"]
