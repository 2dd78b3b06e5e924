"""Schemas of the tables that operators exchange."""

SHIFTS = (
    "workplace_id string, date date, ym string, type string, start string, end string, all_day boolean, is_special boolean, is_work boolean, "
    "is_validated boolean, break_minutes string, pep_target string, contract_target string, actual string, account_daily string, "
    "account_cumulative string, oncall_percent string, oncall_rated string, src_doc string, src_seq long"
)
PAYSLIP_LINES = "workplace_id string, pay_month string, service_month string, seq int, la string, text string, qty double, unit string, rate double, amount double"
DUTY_CODES = "scope string, ord int, start string, end string, start_min int, end_min int, is_special boolean, code string, also array<string>, type string, validated boolean"
COMPOSE_RULES = "scope string, ord int, id string, label string, when string, codes array<string>, next_codes array<string>, start string, end string, type string"
ALIASES = "scope string, ord int, alias string, target string"
COLOURS = "scope string, code string, hex string"
TOKENS = "page_id string, token_id long, text string, x double, y double, w double, h double"
GRID = "page_id string, row_idx int, person string, day_idx int, day int, cell string"
HOURS = ("paid_bd", "time_off", "bd15", "bd_sun_hol25", "bd_night", "bd_night004", "active_night", "sunday_reg", "holiday_reg", "saturday_reg")
DUTY_TYPES = "ord int, id string, category string, match_type string, codes array<string>, " + ", ".join(f"{h} double" for h in HOURS)
PAY_LINES = "ord int, la string, text string, kind string, compare boolean"
TARIFF = "eg string, stage int, salary double, bd double"
