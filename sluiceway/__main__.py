"""``python -m sluiceway``."""

import sys

from sluiceway.cli import main

sys.exit(main())
