"""``python -m symgrid``."""

import sys

from symgrid.cli import main

sys.exit(main())
