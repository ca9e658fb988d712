"""gridlore: exact, explainable analysis of tables on Spark."""

from gridlore.operators.aggregates import *  # noqa: F401,F403
from gridlore.operators.charts import *  # noqa: F401,F403
from gridlore.operators.drilldown import *  # noqa: F401,F403
from gridlore.operators.filters import *  # noqa: F401,F403
from gridlore.operators.forecast import *  # noqa: F401,F403
from gridlore.operators.grounding import *  # noqa: F401,F403
from gridlore.operators.privacy import *  # noqa: F401,F403
from gridlore.operators.profile import *  # noqa: F401,F403
from gridlore.operators.quality import *  # noqa: F401,F403
from gridlore.operators.ranking import *  # noqa: F401,F403
from gridlore.operators.roles import *  # noqa: F401,F403
from gridlore.plans.report import *  # noqa: F401,F403
from gridlore.sources.files import *  # noqa: F401,F403
from gridlore.sources.query import *  # noqa: F401,F403
from gridlore.streaming.admission import *  # noqa: F401,F403
