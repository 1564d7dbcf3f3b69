"""Explicit schemas of the tables the engine reads and writes."""

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "float": T.FloatType(), "bigint": T.LongType(), "int": T.IntegerType(), "timestamp": T.TimestampType(), "array<float>": T.ArrayType(T.FloatType()), "array<double>": T.ArrayType(T.DoubleType())}


def _s(text: str) -> T.StructType:
    """Without a session, unlike ``fromDDL``."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in text.split(", "))])


CANDLE = _s("Open_time timestamp, Open double, High double, Low double, Close double, Volume double, Close_time bigint, Quote_volume string, Trades bigint, Taker_buy_base string, Taker_buy_quote string, Ignore string")
BANK = _s("row_id bigint, episode_id bigint, tick bigint, action bigint, mc_return float, state array<float>")
BANK_CONFIG = _s("state_dim bigint, action_dim bigint, k bigint, max_size bigint, min_tick_gap bigint, n_commits bigint, n_prunes bigint, next_episode_id bigint, signal_threshold double, eps_dist double, max_weight_ratio double")
