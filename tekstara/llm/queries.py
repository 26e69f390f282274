"""The subpackage's queries and their SQL."""

from .decontam import op9_decontamination
from .html_extract import op10_html_extraction
from .langid import op4_language_id
from .license import op1_license
from .neardup import op5_near_duplicates
from .ngram_lm import op6_lm_scoring
from .packing import op2_packing
from .quality import OP7_SQL, op7_quality
from .sharding import op3_sharding
from .warc import op8_warc

QUERIES = {f.__name__: f for f in (op1_license, op2_packing, op3_sharding, op4_language_id, op5_near_duplicates, op6_lm_scoring, op7_quality, op8_warc, op9_decontamination, op10_html_extraction)}
#: The other queries return what SQL can't express; tests hold them against brute force.
ORACLE_SQL = {"op7_quality": OP7_SQL}
