"""Model-evaluation analytics on Spark DataFrames.

Every operator takes DataFrames and returns a DataFrame. Mastery values (theta) travel in
wide form, one array per model indexed by skill id, and are exploded only where a query
groups by skill.
"""
