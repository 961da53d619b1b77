"""All queries on the domain's operators; importing the modules registers them."""

from adit.plans import feeds as feeds
from adit.plans import graphs as graphs
from adit.plans import mapping as mapping
from adit.plans import products as products
from adit.plans import relations as relations
from adit.plans import texts as texts
from adit.plans import vectors as vectors
from adit.plans.registry import QUERIES as QUERIES
from adit.plans.registry import SQL as SQL
