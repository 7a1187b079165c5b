"""Training-data operators: the ten corpus operators and their registered queries.

Nothing else in the library imports this subpackage; deleting it leaves the
track, place and route operators untouched.
"""
