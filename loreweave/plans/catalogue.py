"""All registered queries."""

from loreweave.plans import sql_tables  # noqa: F401
from loreweave.plans import retrieval_plans, graph_plans, extraction_plans, answer_plans, table_plans  # noqa: F401
from loreweave.plans.registry import PLANS, SQL  # noqa: F401
