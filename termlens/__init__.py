"""termlens: corpus-scale text attribution analytics on Spark DataFrames.

Every public function maps DataFrame(s) to a DataFrame; nothing is collected to the driver
except bounded configuration (task maps, fixed word lists) and one-row statistics.
"""

__version__ = "0.1.0"
