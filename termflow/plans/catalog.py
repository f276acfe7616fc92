"""Imports every query module so the registry is complete."""
import termflow.plans.base_sql  # noqa: F401
import termflow.plans.q_panel  # noqa: F401
import termflow.plans.q_vol  # noqa: F401
import termflow.plans.q_xs  # noqa: F401
import termflow.plans.q_trend  # noqa: F401
import termflow.plans.q_backtest  # noqa: F401
import termflow.plans.q_curve  # noqa: F401
import termflow.plans.q_cross  # noqa: F401
import termflow.plans.q_rv  # noqa: F401
import termflow.plans.q_combine  # noqa: F401
import termflow.plans.q_ingest  # noqa: F401
import termflow.plans.q_tables  # noqa: F401
import termflow.plans.q_state  # noqa: F401
import termflow.plans.q_risk  # noqa: F401
import termflow.plans.q_book  # noqa: F401
import termflow.plans.q_stats  # noqa: F401
import termflow.plans.q_tuning  # noqa: F401
import termflow.plans.q_registry  # noqa: F401
import termflow.plans.q_stream  # noqa: F401
