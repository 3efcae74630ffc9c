"""Runs the command line."""

import sys

from codestrata.cli import main

sys.exit(main())
